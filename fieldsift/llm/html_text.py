"""Main text of web pages by differencing a page with its nearest neighbour on the same host.

Pages are sorted by (host, path, page_id); a page's pair is the one of its two neighbours on the host whose path agrees
with its own for longer, the earlier one where both agree equally. Neighbours with just the same lines are copies and no
pair: the next page of other lines is taken. The lines (blocks) of both are aligned by their longest common subsequence,
and what they share goes: site furniture repeats from page to page, the article doesn't. Lines that the markup itself
sets aside (scripts, menus, headers, footers, sidebars, forms, notices, adverts, reader comments) go first. On every page,
differencing decides about all other lines but those inside an article or main element: two articles may share whole
paragraphs, and these are text.

One shuffle of the pages, by ranges of (host, path, page_id), so that a host with a third of all pages is dealt over many
tasks. A range can't see beyond its edges: its first and last group of equal pages are written with what is known about
them, and a second small step joins them to their neighbours in other ranges. The result does not depend on the ranges.

Edge cases: null or empty html gives an empty text; a null url has an empty host and path; pages alone on their host, and
copies that are alone on it, keep their lines; broken and unclosed tags are read as far as they go; repeated pages are
kept, each with its own row; very long pages are read whole, and alignment holds a few rows of bits, no table; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPACE = re.compile(r"\s+")

#: Elements whose text is data, elements that are never part of an article, and inline elements.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "canvas", "object", "head"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words in class, id or role that mark site furniture.
FURNITURE = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "contentinfo", "cookie", "cookies", "disqus", "footer", "header",
    "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pagination", "popup", "promo", "promotion", "related", "replies", "reply",
    "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "teaser", "toolbar", "widget",
}


def _furniture(attributes: str) -> bool:
    for m in _NAMES.finditer(attributes):
        words = re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())
        if not FURNITURE.isdisjoint(words):
            return True
    return False


def page_lines(page: str) -> list[tuple[str, bool]]:
    """The page's lines outside of elements that the markup sets aside, and whether each is inside an article element."""
    lines: list[tuple[str, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, skipped, in an article

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                lines.append((text, bool(stack) and stack[-1][2]))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        skipped = bool(stack) and stack[-1][1]
        if not skipped:
            held.append(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name not in INLINE:
            flush()
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID or m[3].endswith("/") or name in INLINE:
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()
        article = name in ("article", "main")
        above = stack[-1] if stack else ("", False, False)
        if article and above[1] and not any(x[0] == "article" or (x[1] and x[0] not in ASIDE) for x in stack):
            stack.clear()  # an unclosed menu or header before the article
            above = ("", False, False)
        if name == "body":
            stack.clear()
            above = ("", False, False)
        # an article's own header is still part of it
        aside = (name in ASIDE and not (name == "header" and above[2])) or (name != "body" and not article and _furniture(m[3]))
        stack.append((name, above[1] or aside, above[2] or article))
    flush()
    return lines


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each prefix of b, 0 first; a row of bits, one step per line of a."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        met = row & where.get(x, 0)
        row = ((row + met) | (row - met)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Positions in mine that belong to a longest common subsequence of both, halving mine until single lines are left."""
    number = {x: k for k, x in enumerate(set(mine) & set(other))}
    at = [i for i, x in enumerate(mine) if x in number]
    todo = [(0, [number[mine[i]] for i in at], [number[x] for x in other if x in number])]
    out: set[int] = set()
    while todo:
        base, a, b = todo.pop()
        lead = 0
        while lead < min(len(a), len(b)) and a[lead] == b[lead]:
            out.add(at[base + lead])
            lead += 1
        base, a, b = base + lead, a[lead:], b[lead:]
        while a and b and a[-1] == b[-1]:
            out.add(at[base + len(a) - 1])
            a, b = a[:-1], b[:-1]
        if len(a) == 1 and a[0] in b:
            out.add(at[base])
        elif len(a) > 1 and b:
            half = len(a) // 2
            cut = int(np.argmax(_prefix_lengths(a[:half], b) + _prefix_lengths(a[half:][::-1], b[::-1])[::-1]))
            todo += [(base, a[:half], b[:cut]), (base + half, a[half:], b[cut:])]
    return out


def _agree(x: str, y: str) -> int:
    n = 0
    for p, q in zip(x, y):
        if p != q:
            break
        n += 1
    return n


def main_text(lines: list[tuple[str, bool]], other: list[tuple[str, bool]] | None) -> str:
    """The page's text, given its nearest neighbour's lines: shared lines go but for those inside an article element."""
    open_ = other is not None and not all(inside for _, inside in lines)
    gone = shared_lines([x for x, _ in lines], [x for x, _ in other]) if open_ else set()
    return " ".join(x for k, (x, inside) in enumerate(lines) if inside or k not in gone)


def url_parts(url) -> tuple:
    """Host (A-Z lower-cased) and path columns of a url column."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, pattern, 2)


def packed(lines: list[tuple[str, bool]]) -> bytes:
    """Lines as one compressed text: lines hold no line end, and a sign before each tells whether it is inside an article."""
    return zstandard.compress("\n".join(("+" if inside else "-") + x for x, inside in lines).encode("utf-8", "replace"), 3)


def unpacked(data: bytes) -> list[tuple[str, bool]]:
    text = zstandard.decompress(data).decode()
    return [(x[1:], x[0] == "+") for x in text.split("\n")] if text else []


def _table(fields: str) -> tuple[str, pa.Schema]:
    """The same columns for Spark and for Arrow."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return fields, pa.schema([(name, kinds[kind]) for name, kind in map(str.split, fields.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names=schema.names)


_LINES, _LINES_ARROW = _table("page_id long, url string, host string, path string, lines binary")
_RESULT, _RESULT_ARROW = _table("page_id long, url string, text string, n_chars long")
#: Settled pages; pages of a range's first or last group with the best that the range knows (part set); and these groups
#: (lines set) with their outer paths and their neighbour inside the range.
_READ, _READ_ARROW = _table(
    f"{_RESULT}, part int, last boolean, path string, agree int, host string, lines binary, first_path string, last_path string, inner_path string, inner_lines binary"
)
_BEYOND, _BEYOND_ARROW = _table("part int, last boolean, lines binary, prev_path string, prev_lines binary, next_path string, next_lines binary")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = pa.array([packed(page_lines(x)) for x in batch.column("html").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _LINES_ARROW.names[:-1]), lines], names=_LINES_ARROW.names)


class _Group:
    """Neighbouring pages of one host with the same lines."""

    def __init__(self, host: str, lines: bytes, page: tuple):
        self.host, self.lines, self.pages = host, lines, [page]  # pages: page_id, url, path

    def settle(self, before: tuple | None, after: tuple | None) -> Iterator[tuple]:
        """page_id, url, text, path and the agreement with the chosen neighbour (path, lines), -1 without one."""
        texts: dict[bool, str] = {}
        for page_id, url, path in self.pages:
            near = [(_agree(x[0], path), first) for first, x in ((True, before), (False, after)) if x is not None]
            agree, first = max(near) if near else (-1, True)
            if first not in texts:
                pair = before if first else after
                texts[first] = main_text(unpacked(self.lines), unpacked(pair[1]) if pair else None)
            yield page_id, url, texts[first], path, agree


def _read_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settles the pages of one sorted range; its first and last group are told apart as edges."""
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    before: _Group | None = None
    group: _Group | None = None

    def close(after: _Group | None) -> None:
        prev = (before.pages[-1][2], before.lines) if before is not None and before.host == group.host else None
        nxt = (after.pages[0][2], after.lines) if after is not None and after.host == group.host else None
        edge = before is None or after is None
        last = before is not None
        for page_id, url, text, path, agree in group.settle(prev, nxt):
            out.append((page_id, url, text, len(text), *((part, last, path, agree) if edge else (None,) * 4), *(None,) * 6))
        if edge:
            inner = (prev if last else nxt) or (None, None)
            out.append((*(None,) * 4, part, last, None, None, group.host, group.lines, group.pages[0][2], group.pages[-1][2], *inner))

    for batch in batches:
        for page_id, url, host, path, lines in zip(*(batch.column(c).to_pylist() for c in _LINES_ARROW.names)):
            if group is not None and group.host == host and group.lines == lines:
                group.pages.append((page_id, url, path))
                continue
            new = _Group(host, lines, (page_id, url, path))
            if group is not None:
                close(new)
                before = group
            group = new
            if len(out) > 500:
                yield _batch(out, _READ_ARROW)
                out.clear()
    if group is not None:
        close(None)
    if out:
        yield _batch(out, _READ_ARROW)


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each edge's neighbours beyond its range, from the edges of all ranges in order (two rows per range at most).

    Edges with the same host and lines are one group of copies that lies in several ranges, and see past each other.
    """
    edges = [r for b in batches for r in b.to_pylist()]
    alone = [not x["last"] and (k + 1 == len(edges) or edges[k + 1]["part"] != x["part"]) for k, x in enumerate(edges)]

    def look(k: int, step: int) -> tuple:
        own, j = edges[k], k + step
        while 0 <= j < len(edges) and edges[j]["host"] == own["host"]:
            x = edges[j]
            if x["lines"] != own["lines"]:
                return x["last_path" if step < 0 else "first_path"], x["lines"]
            if not alone[j]:
                return x["inner_path"], x["inner_lines"]
            j += step
        return None, None

    for k, x in enumerate(edges):
        prev = (None, None) if x["last"] else look(k, -1)
        nxt = look(k, 1) if x["last"] or alone[k] else (None, None)
        yield _batch([(x["part"], x["last"], x["lines"], *prev, *nxt)], _BEYOND_ARROW)


def _settle_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of edge groups with their neighbours beyond the range: the longer agreement wins, the earlier page on ties."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            text, agree = r["text"], r["agree"]
            for path, lines, earlier in ((r["prev_path"], r["prev_lines"], True), (r["next_path"], r["next_lines"], False)):
                if path is not None and (n := _agree(path, r["path"])) >= agree + (not earlier):
                    text, agree = main_text(unpacked(r["lines"]), unpacked(lines)), n
            rows.append((r["page_id"], r["url"], text, len(text)))
        if rows:
            yield _batch(rows, _RESULT_ARROW)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    parsed = rows.withColumns({"host": host, "path": path}).mapInArrow(_parse, _LINES)
    dealt = parsed.repartitionByRange(n, "host", "path", "page_id").sortWithinPartitions("host", "path", "page_id", "url", "lines")
    settled = as_table(dealt.mapInArrow(_read_range, _READ), "html-text")
    edges = settled.where("lines is not null").select("part", "last", "host", "lines", "first_path", "last_path", "inner_path", "inner_lines")
    beyond = edges.repartition(1).sortWithinPartitions("part", "last").mapInArrow(_join_edges, _BEYOND)  # two rows per range
    pending = settled.where("part is not null and lines is null").select(*_RESULT_ARROW.names, "part", "last", "path", "agree")
    mended = pending.join(beyond, ["part", "last"]).mapInArrow(_settle_edges, _RESULT)
    return settled.where("part is null").select(*_RESULT_ARROW.names).unionByName(mended)
