"""Registered corpus queries against their oracle SQL, and documents cut of repeats against the spans."""

import duckdb
import pytest

queries = pytest.importorskip("fieldsift.llm.queries")

from fieldsift.llm import suffix_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine = queries.QUERIES[name](spark, SF)
    other = db.execute(f"select {', '.join(mine.columns)} from ({queries.ORACLES[name]})").fetchall()
    key = lambda row: [(x is not None, x) for x in row]
    assert sorted(map(tuple, mine.collect()), key=key) == sorted(other, key=key)


def test_cut_documents_keeps_columns_and_drops_repeats(spark):
    passage = "0123456789" * 3 + "abcdefghijklmnopqrstuvwxyz"
    rows = [(1, "one " + passage, "en", 7, [1]), (2, passage + " two", None, 8, None), (3, None, "de", 0, []), (4, "é" * 30, "fr", 30, [4]), (5, "x" + "é" * 30, "fr", 31, [5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, tags array<int>")
    cut = suffix_dedup.cut_documents(docs)
    assert cut.columns == docs.columns
    got = {r.doc_id: r for r in cut.collect()}
    assert got[1].text == "one " + passage and got[2].text == " two" and got[3].text == ""
    assert got[4].text == "é" * 30 and got[5].text == "x"
    assert (got[2].n_chars, got[2].lang, got[1].tags, got[2].tags) == (4, None, [1], None)
    assert suffix_dedup.cut_documents(docs.limit(0)).collect() == []
