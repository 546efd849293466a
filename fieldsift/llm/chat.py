"""Chat formatting by a grammar round trip.

    conversation := turn*        turn := START role "\\n" text END "\\n"

Each turn is rendered as it is and read back by the deterministic parser; where what comes back isn't the source, the
turn's role or text is escaped, rendered and read again. The finished text is parsed once more as a whole and compared to
the source, so what leaves the operator is proven to read back. Escapes put a backslash behind the first character of a
control string; the parser undoes them everywhere, so it needs to know nothing of the source.

A conversation is one row, or, above PART_BYTES, rows of whole turns whose texts follow each other as its parts: memory is
bounded by a part (or one turn) while a conversation may be of any length. Its turns need their order, so one
conversation's rows meet in one task, which streams them.

Edge cases: null roles and texts become empty; turns go by turn (null first), ties by role and text; repeated rows are
turns of their own; rows without conv_id are one conversation whose conv_id is null; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_BYTES = 8_000_000

FORMATTED = "conv_id long, part int, n_turns long, text string, loss array<struct<start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Unreadable(ValueError):
    """The text doesn't follow the grammar."""


@dataclass(frozen=True)
class Template:
    """Control strings of a chat grammar, and the roles whose texts are learned."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    learned: tuple[str, ...] = ("assistant",)
    _escaped: re.Pattern = field(init=False, repr=False, compare=False)
    _escape: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        controls = (self.start, self.end)
        if any(len(c) < 2 or c[1] in "\\n" or c[0] in c[1:] or "\n" in c for c in controls) or self.start == self.end:
            raise ValueError("control strings are two or more characters, begin with one that doesn't come again, and don't go on with a backslash or n")
        heads = "[" + "".join(re.escape(c) for c in sorted({c[0] for c in controls})) + "]"
        object.__setattr__(self, "_escape", re.compile(heads + r"\\|" + "|".join(map(re.escape, controls))))
        object.__setattr__(self, "_escaped", re.compile("(" + heads + r")\\(.?)", re.DOTALL))

    def escape(self, text: str, one_line: bool = False) -> str:
        out = self._escape.sub(lambda m: m[0] + "\\" if m[0][1:] == "\\" else m[0][0] + "\\" + m[0][1:], text)
        return out.replace("\n", self.start[0] + "\\n") if one_line else out

    def unescape(self, text: str) -> str:
        seconds = {c[:2] for c in (self.start, self.end)}

        def back(m: re.Match) -> str:
            if m[2] == "\\":
                return m[1] + "\\"
            if m[2] == "n":
                return "\n"
            if m[1] + m[2] in seconds:
                return m[1] + m[2]
            raise Unreadable("no such escape")

        return self._escaped.sub(back, text) if "\\" in text else text

    def render(self, role: str, text: str) -> str:
        return f"{self.start}{role}\n{text}{self.end}\n"

    def read_turn(self, text: str, at: int) -> tuple[str, str, int, int, int]:
        """role, text, where the text begins and ends, and where the next turn begins."""
        if not text.startswith(self.start, at):
            raise Unreadable("a turn doesn't begin here")
        line = text.find("\n", at)
        end = text.find(self.end, line + 1)
        if line < 0 or end < 0 or not text.startswith("\n", end + len(self.end)):
            raise Unreadable("a turn doesn't end")
        role, body = text[at + len(self.start) : line], text[line + 1 : end]
        if self.start in body or self.start in role or self.end in role:
            raise Unreadable("a turn begins within a turn")
        return self.unescape(role), self.unescape(body), line + 1, end, end + len(self.end) + 1

    def read(self, text: str) -> Iterator[tuple[str, str, int, int]]:
        """role, text, and where the (escaped) text begins and ends, of each turn."""
        at = 0
        while at < len(text):
            role, body, start, end, at = self.read_turn(text, at)
            yield role, body, start, end

    def _reads_back(self, rendered: str, role: str, text: str) -> bool:
        try:
            found = self.read_turn(rendered, 0)
        except Unreadable:
            return False
        return found[:2] == (role, text) and found[4] == len(rendered)

    def format(self, turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The turns' text, and the spans of what is learned in it. Raises if it doesn't read back."""
        turns = list(turns)
        pieces = []
        for role, text in turns:
            tries = ((role, text), (role, self.escape(text)), (self.escape(role, True), text), (self.escape(role, True), self.escape(text)))
            pieces.append(next((r for r in (self.render(*t) for t in tries) if self._reads_back(r, role, text)), ""))
        whole = "".join(pieces)
        found = list(self.read(whole))
        if [x[:2] for x in found] != turns:
            raise Unreadable("the rendered text doesn't read back")
        return whole, [(s, e) for role, _, s, e in found if role in self.learned]


CHATML = Template()


def format_chats(turns: DataFrame, template: Template = CHATML, part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id, part (from 0), n_turns, text and loss (spans of code points in text) of each conversation of turns.

    turns: conv_id, turn, role, text. The parts of a conversation lie together in one partition, in their order.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(5)]
        held: list[tuple[str, str]] = []
        size = written = part = 0
        last: tuple = ()

        def close() -> None:
            nonlocal size, written
            text, loss = template.format(held)
            for column, value in zip(out, (last[0], part, len(held), text, [{"start": s, "end": e} for s, e in loss])):
                column.append(value)
            written += size + 100
            size = 0
            held.clear()

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if held and (conv,) != last:
                    close()
                elif held and size + len(text) > part_bytes:
                    close()
                    part += 1
                if (conv,) != last:
                    last, part = (conv,), 0
                held.append((role, text))
                size += len(role) + len(text)
                if written > part_bytes:
                    yield _formatted(out)
                    out, written = [[] for _ in range(5)], 0
        if held:
            close()
        if out[0]:
            yield _formatted(out)

    dealt = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def _formatted(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), _SPANS)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["conv_id", "part", "n_turns", "text", "loss"])


def digest_chats(formatted: DataFrame, template: Template = CHATML, in_order: bool = False) -> DataFrame:
    """Digests of what formatted chats read back to, per conversation; parts are streamed, only hashes are held.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. in_order: the parts of each conversation
    already lie in one partition in their order, as format_chats leaves them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out: list[list] = [[] for _ in names]
        key: tuple = ()
        n = loss_chars = chars = 0
        turns = loss = hashlib.sha256()

        def close() -> None:
            for column, value in zip(out, (key[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)):
                column.append(value)

        for batch in batches:
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss"))):
                if (conv,) != key:
                    if key:
                        close()
                    key, n, loss_chars, chars = (conv,), 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, body, _, _ in template.read(text):
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                for span in spans:
                    learned = template.unescape(text[span["start"] : span["end"]])
                    loss.update(learned.encode())
                    loss_chars += len(learned)
                chars += len(text)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)
                out = [[] for _ in names]
        if key:
            close()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return formatted.select("conv_id", "part", "text", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
