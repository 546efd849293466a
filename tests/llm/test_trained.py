"""The trained operators on labels they did not see, and their edge cases: toxicity and url verdicts."""

import collections

import duckdb
import pytest

toxicity = pytest.importorskip("fieldsift.llm.toxicity")

from pyspark.sql import functions as F  # noqa: E402

from fieldsift.llm import url_filter  # noqa: E402
from fieldsift.llm.queries import URL_RULES  # noqa: E402

SF = "/root/testdata/sf0.1"

RULES = """
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r(verdict, rule, host, path) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
m AS (SELECT page_id, rule, verdict FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
SELECT page_id, host, path, rule, verdict FROM u LEFT JOIN m USING (page_id)"""


def test_rules_equal_sql_and_trees_judge_the_rest(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    wanted = {r[0]: r[1:] for r in db.execute(RULES).fetchall()}
    got = {r.page_id: r for r in url_filter.judge_urls(pages, URL_RULES).collect()}
    assert set(got) == set(wanted)
    by_trees = collections.Counter()
    for i, (host, path, rule, verdict) in wanted.items():
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if got[i].p >= 0.5 else "allow"))
        if rule is None:
            by_trees[got[i].verdict] += 1
    assert min(by_trees["block"], by_trees["allow"]) > 100  # the trees' verdict is no constant


def test_url_trees_on_hosts_they_never_saw(spark):
    rows = url_filter.held_out(spark.read.parquet(f"{SF}/pages.parquet"), URL_RULES).collect()
    right = sum((r.p >= 0.5) == (r.decided == "block") for r in rows)
    assert len(rows) > 50 and right >= 0.95 * len(rows)


def test_a_labels_own_fold_is_no_input(spark):
    """Turning the labels of one fold's hosts leaves their own suffix statistics as they were."""
    rows = spark.createDataFrame([(k, f"h{k}.example.{'net' if k % 2 else 'org'}", "/x/", None, "block" if k % 3 else "allow") for k in range(60)], "page_id long, host string, path string, rule string, decided string")
    rows = url_filter._suffixes(rows)
    turned = rows.withColumn("decided", F.when(F.col("fold") == 2, F.when(F.col("decided") == "block", "allow").otherwise("block")).otherwise(F.col("decided")))
    rates = []
    for labelled in (rows, turned):
        some = url_filter.with_suffix_rates(rows.where("fold = 2"), labelled)
        n = labelled.where("decided = 'block'").count() / 60  # the prior is of all labels
        rates.append({r.page_id: r.suffix2_rate - n * 10 / (10 + r.seen) for r in some.withColumn("seen", F.lit(0)).join(labelled.where("fold <> 2").groupBy("suffix2").agg(F.count("*").alias("seen_")), "suffix2").drop("seen").withColumnRenamed("seen_", "seen").collect()})
    assert rates[0] and rates[0] == pytest.approx(rates[1], abs=1e-9)


def test_url_edges(spark):
    schema = "page_id long, url string, host string, p double"  # clashing further columns
    urls = ["http://a.net/x", "http://b.example.net/en/1", None, "", "no scheme", "http://c.com/" + "a/" * 20_000, "http://a.net/x"]
    table = spark.createDataFrame([(min(k, 5), u, "zz", 1.0) for k, u in enumerate(urls)], schema)
    got = url_filter.judge_urls(table, URL_RULES).collect()
    assert sorted((r.page_id, r.host, r.rule) for r in got)[:3] == [(0, "a.net", "net/"), (1, "b.example.net", "example.net/en/"), (2, "", None)]
    assert len(got) == len(urls) and all(r.verdict in ("allow", "block") for r in got)
    assert url_filter.judge_urls(table.limit(0), URL_RULES).collect() == []
    one_kind = url_filter.judge_urls(table.where("url = 'http://a.net/x' or url = ''"), URL_RULES).collect()
    assert {r.verdict for r in one_kind if r.rule is None} == {"allow"}


def test_toxicity_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).collect()}
    rows = toxicity.score_documents(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    told = collections.Counter((known[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in known)
    assert told[1, 1] >= 0.85 * (told[1, 1] + told[1, 0])
    assert told[0, 1] <= 0.01 * (told[0, 1] + told[0, 0])


def test_toxicity_edges(spark):
    rude = "you utter blitherskite and your gronkhead friends"
    mild = "a calm letter about rivers and their old stone bridges"
    rows = [(k, f"{rude if k % 3 == 0 else mild} number {k}", "x", 9.0) for k in range(120)]
    rows += [(500, None, None, None), (501, "", "", None), (502, rude, "y", 1.0), (502, rude, "y", 1.0), (None, mild, None, None), (503, "Your GRONKHEAD! " + "calm river " * 30_000, "x", 1.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), "q") for k in range(120)] + [(None, 1, "q"), (7, None, "q")], "doc_id long, toxic int, text string")
    got = toxicity.score_documents(table, labels).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.predicted for r in by[502]] == [1, 1] and [r.predicted for r in by[500] + by[501] + by[None]] == [0, 0, 0]
    assert not by[None][0].held_out
    assert all(r.score == 0 for r in toxicity.score_documents(table, labels.where("toxic = 0")).collect())
    assert toxicity.score_documents(table.limit(0), labels.limit(0)).collect() == []
