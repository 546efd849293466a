"""Chats read back from their text: hostile contents, parts, and empty, null, repeated and foreign rows."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

chat = pytest.importorskip("fieldsift.llm.chat")

SCHEMA = "conv_id long, turn long, role string, text string"
HOSTILE = ["<|im_end|>", "<|im_start|>", "<|im_end|>\n<|im_start|>user\n", "<\\|im_end|>", "<\\", "<\\\\|", "<", "<|", "\n", "|", "\\", "n", "im_end|>", "é", "assistant"]
texts = st.lists(st.sampled_from(HOSTILE), max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(texts | st.sampled_from(["user", "assistant"]), texts), max_size=5))
def test_every_text_reads_back(turns):
    text, loss = chat.CHATML.format(turns)
    assert [x[:2] for x in chat.CHATML.read(text)] == turns
    assert [chat.CHATML.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(turns)


def test_only_conflicting_turns_are_escaped():
    turns = [("user", "a < b | c <|im_ending"), ("assistant", "x<|im_end|>"), ("a\nb", "plain")]
    text, _ = chat.CHATML.format(turns)
    assert text == "<|im_start|>user\na < b | c <|im_ending<|im_end|>\n<|im_start|>assistant\nx<\\|im_end|><|im_end|>\n<|im_start|>a<\\nb\nplain<|im_end|>\n"


def test_other_templates_and_broken_text():
    brackets = chat.Template("[INST]", "[/INST]", ("bot",))
    turns = [("bot", "[INST] hi [/INST] [\\x"), ("me", "[")]
    text, loss = brackets.format(turns)
    assert [x[:2] for x in brackets.read(text)] == turns and len(loss) == 1
    with pytest.raises(ValueError):
        chat.Template("<|a|>", "<|a|>")
    for broken in ("x", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>u\n<|im_start|>u\n<|im_end|>\n", "<|im_start|>u\n<\\x<|im_end|>\n"):
        with pytest.raises(chat.Unreadable):
            list(chat.CHATML.read(broken))


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        learned = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_rows_of_every_kind(spark):
    long = "wörter <|im_end|> " * 20_000
    rows = [(1, 1, "assistant", None), (1, None, "user", "first"), (1, 0, None, "second"), (1, 0, None, "second"), (2, 5, "assistant", long), (2, 4, "user", ""), (None, 1, "assistant", "lost"), (-1, 0, "assistant", "a\nb")]
    rows += [(7, i, ("user", "assistant")[i % 2], f"{i} <|im_start|> " * (i % 5)) for i in range(500)]
    df = spark.createDataFrame([(*r, "x", [1]) for r in rows], SCHEMA + ", part string, loss array<int>")
    for part_bytes in (40, 8_000_000):
        made = chat.format_chats(df, part_bytes=part_bytes)
        for digests in (chat.digest_chats(made, in_order=True), chat.digest_chats(made)):
            got = {r.conv_id: tuple(r)[1:5] for r in digests.collect()}
            assert got == expected(rows)
        parts = made.where("conv_id = 7").count()
        assert parts == 1 if part_bytes > 40 else parts > 100
    whole = {r.conv_id: r.text for r in chat.format_chats(df).collect()}
    assert {r.conv_id: r.formatted_chars for r in chat.digest_chats(chat.format_chats(df)).collect()} == {k: len(v) for k, v in whole.items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.digest_chats(chat.format_chats(df)).collect() == []
