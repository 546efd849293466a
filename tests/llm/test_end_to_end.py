"""The pipeline and the url trees from end to end, against labels, rules and what each stage was given."""

import collections

import pytest

pytest.importorskip("fieldsift.llm.queries")

import corpus_pipeline  # noqa: E402
from fieldsift.llm import minhash, url_filter  # noqa: E402
from fieldsift.llm.queries import URL_RULES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline_stages_only_drop_and_pack_all_that_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.as_table(stage(spark, docs, SF), f"test-{name}")
        left = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and len(left) == len(set(left)) and set(left) <= ids
        ids = set(left)
        if name == "quality_rules":
            assert not [i for i in ids if i in labels and labels[i].quality == 0]
        if name == "minhash_dedup":
            assert minhash.near_duplicates(docs, words=5, percent=80).where("not kept").count() == 0
    held = collections.Counter()
    size = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        held[r.doc_id] += r.length
        size[r.doc_id] = r.doc_tokens
    assert dict(held) == size and set(size) == ids


def test_url_trees_judge_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    decided = {r.page_id: r.decided for r in url_filter.by_rules(pages, URL_RULES).collect()}
    got = {r.page_id: r for r in url_filter.judge_urls(pages, URL_RULES).collect()}
    assert set(got) == set(decided)
    for i, verdict in decided.items():
        assert got[i].verdict == (verdict or ("block" if got[i].p >= 0.5 else "allow"))
