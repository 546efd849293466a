"""Repeated rows, empty tables and clashing further columns on the operators over documents, and on every pipeline stage."""

import collections

import pytest

pytest.importorskip("fieldsift.llm.queries")

import corpus_pipeline  # noqa: E402
from fieldsift.llm import byte_bpe, minhash, packing, quality, suffix_dedup, token_counts  # noqa: E402

SF = "/root/testdata/sf0.001"
ROWS = [(1, "The river, the stone and the bridge of an old town " * 9), (1, "The river, the stone and the bridge of an old town " * 9), (2, None), (3, ""), (None, "no id"), (4, "tie " * 3), (5, "TIE tie tie")]
#: Names that the operators use inside.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, ids string, r long, bucket double, row string, node long, `a.b` int, features string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, "en", "s", 1, "i", 2, 0.5, "row", 3, 4, "f") for x in ROWS], CLASH).repartition(2)


OPERATORS = {
    "token_counts": token_counts.count_tokens,
    "byte_bpe": lambda d: byte_bpe.decode_documents(byte_bpe.encode_documents(d)),
    "quality": quality.judge,
    "minhash": lambda d: minhash.near_duplicates(d, 3, 85),
    "suffix_dedup": suffix_dedup.repeated_spans,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, name):
    plain = OPERATORS[name](docs.select("doc_id", "text", "lang", "source"))
    got, wanted = OPERATORS[name](docs), sorted(map(str, plain.collect()))
    assert sorted(map(str, got.collect())) == wanted and len(wanted) == len(ROWS)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(i) for i, _ in ROWS)
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_near_duplicates_of_repeated_rows(docs):
    got = collections.defaultdict(list)
    for r in minhash.near_duplicates(docs, 3, 85).collect():
        got[r.doc_id].append((r.component_id, r.kept))
    assert got == {1: [(1, True)] * 2, 2: [(2, True)], 3: [(3, True)], None: [(None, True)], 4: [(4, True)], 5: [(4, False)]}


def test_packing_holds_every_row_as_often_as_it_comes(docs):
    pieces = packing.pack(docs).collect()
    held = collections.Counter()
    for r in pieces:
        held[r.doc_id] += r.length
    tokens = {r.doc_id: r.doc_tokens for r in pieces}
    assert held == {i: n * (2 if i == 1 else 1) for i, n in tokens.items()} and len(tokens) == len({i for i, _ in ROWS})
    assert packing.pack(docs.limit(0)).collect() == []


@pytest.mark.parametrize("empty", [False, True])
def test_stages_return_the_columns_they_got(spark, docs, empty):
    rows = docs.limit(0) if empty else docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.as_table(stage(spark, rows, SF), f"edges-{name}")
        assert out.dtypes == rows.dtypes and out.count() <= len(ROWS)
        assert (out.count() == 0) if empty else (name == "quality_rules" or out.count() >= len(ROWS) - 1)
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() >= (0 if empty else len(ROWS))
