"""op5's counts against SQL, its cutoffs against exact quantiles, and its verdicts against labels and hand-made groups."""

import collections
import random

import duckdb
import numpy as np
import pytest

quality = pytest.importorskip("fieldsift.llm.quality")

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string"

COUNTS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dups FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1), range(0, 3) x(k) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines,
 coalesce(r.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)"""


@pytest.fixture(scope="module")
def judged(spark):
    return quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()


def test_counts_equal_sql(judged):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    wanted = db.execute(COUNTS).fetchdf().sort_values("doc_id").reset_index(drop=True)
    got = judged[list(wanted.columns)].sort_values("doc_id").reset_index(drop=True)
    assert len(got) == len(wanted) and (got == wanted).all().all()


def test_cutoffs_are_the_groups_quantiles(judged):
    """Exact quantiles in place of sketches: each cutoff lies within the sketches' rank error of the exact one."""
    usable = judged[~judged.base_failed].drop_duplicates(["lang", "source", "text_key"])
    by_lang = dict(list(usable.groupby("lang")))
    assert usable.groupby(["lang", "source"]).size().max() < quality.LEAST_DOCS  # small groups: their language decides
    for row in judged.itertuples():
        if row.base_failed:
            assert not row.kept
            continue
        group = by_lang[row.lang] if len(by_lang[row.lang]) >= quality.LEAST_DOCS else usable
        for m in quality.METRIC_NAMES:
            limits = []
            for off in (-0.03, 0.03):
                centre, low = np.quantile(group[m], quality.CENTRE + off), np.quantile(group[m], quality.LOW - off)
                limits.append(centre + quality.SPREAD * (centre - low))
            assert limits[0] <= getattr(row, f"most_{m}") <= limits[1]
        assert row.kept == all(getattr(row, m) <= getattr(row, f"most_{m}") for m in quality.METRIC_NAMES)


def test_verdicts_agree_with_labels(spark, judged):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    told = collections.Counter((labels[r.doc_id], r.kept) for r in judged.itertuples() if r.doc_id in labels and not r.base_failed)
    assert told[0, True] == 0
    assert told[1, False] <= 0.01 * (told[1, True] + told[1, False])


def text(rng, signs, words=120):
    """Words of which a share ends with a sign; the share decides sign_share."""
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 7))) + ("!" if rng.random() < signs else "") for _ in range(words))


def test_one_value_passes_in_one_group_and_fails_in_another(spark):
    rng = random.Random(1)
    plain = [(k, text(rng, 0.05), "en", "plain") for k in range(200)]
    loud = [(1000 + k, text(rng, rng.uniform(0.2, 0.9)), "en", "loud") for k in range(200)]
    same = text(rng, 0.95)
    rows = [*plain, *loud, (1, same, "en", "plain"), (2, same, "en", "loud"), (3, None, None, None), (4, same, None, None), (4, same, None, None)]
    got = spark.createDataFrame(rows, SCHEMA).repartition(3)
    verdicts = quality.judge(got).select("doc_id", "source", "kept", "sign_share", "most_sign_share").collect()
    by = collections.defaultdict(list)
    for r in verdicts:
        by[r.doc_id].append(r)
    assert len(verdicts) == len(rows)
    assert [r.kept for r in by[1] if r.sign_share > 0.1] == [False] and [r.kept for r in by[2] if r.sign_share > 0.1] == [True]
    assert all(r.kept for r in verdicts if r.doc_id >= 1000)
    assert [r.kept for r in by[3] if r.source is None] == [False] and len([r for r in by[4] if r.source is None]) == 2
    cut = quality.thresholds(quality.metrics(got)).select("source", "own_sign_share").collect()
    assert {r.source: r.own_sign_share for r in cut}["loud"]


def test_copies_and_junk_move_no_cutoff(spark):
    """A group of which nine tenths are copies keeps its few other documents; one with a third of junk loses only that."""
    rng = random.Random(2)
    copies = [(k, text(random.Random(3), 0.02), "en", "copies") for k in range(900)]
    others = [(2000 + k, text(rng, 0.06), "en", "copies") for k in range(100)] + [(3000 + k, text(rng, rng.uniform(0.02, 0.1)), "en", "plain") for k in range(400)]
    junk = [(5000 + k, " ".join(w + "###" for w in text(rng, 0.0).split()), "en", "plain") for k in range(200)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame([*copies, *others, *junk], SCHEMA)).collect()}
    assert all(kept == (i < 5000) for i, kept in got.items())
