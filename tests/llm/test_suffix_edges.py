"""Suffix dedup: ids beside nulls, repeated ids, hot anchors, colliding hashes, carried columns."""

import datetime
import random

import numpy as np
import pytest

suffix_dedup = pytest.importorskip("fieldsift.llm.suffix_dedup")


def brute(rows):
    """(doc_id, text) -> the kept bytes of each row, in order of rows."""
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - 49):
            if i is not None:
                w = data[p : p + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if i is not None and first[data[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out.append((i, bytes(x for x, g in zip(data, gone) if not g)))
    return sorted(out, key=str)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def hot_rows():
    """A phrase of twenty bytes and one of seventy, each with other surroundings in many documents."""
    rng = random.Random(4)
    short, long_ = words(rng, 20)[:20], words(rng, 30)[:70]
    rows = [(k, f"{words(rng, 12)} {short if k % 2 else long_} {words(rng, 12)}") for k in range(300)]
    rows += [(400 + k, rows[k % 7][1]) for k in range(30)] + [(None, rows[0][1]), (500, None), (500, rows[3][1]), (7, rows[5][1]), (900, long_ * 900)]
    return rows


@pytest.mark.parametrize("hot", [4096, 40, 1])
def test_hot_anchors_are_exact(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    rows = hot_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.kept_bytes(suffix_dedup.repeated_spans(table, bucket_bytes=9_000)).collect()
    assert sorted([(r.doc_id, bytes(r.kept)) for r in got], key=str) == brute(rows)


def test_large_ids_beside_null_ids(spark):
    big = 2**53
    text = words(random.Random(5), 40)
    rows = [(big + 1, text), (big + 3, text), (None, text), (None, None)]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, bytes(r.kept)) for r in got], key=str) == brute(rows)


def test_other_columns_pass_unchanged(spark):
    text = words(random.Random(6), 40)
    when = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [(k, text, when, [1.5, None], {"a": k}, 3) for k in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, row timestamp, bucket array<double>, `kept.x` map<string, int>, n_chars int")
    cut = suffix_dedup.cut_documents(table)
    assert cut.dtypes == table.dtypes
    assert [(r[0], r[1] == (text if r[0] == 0 else ""), *r[2:5], r[5]) for r in cut.orderBy("doc_id").collect()] == [(k, True, when, [1.5, None], {"a": k}, len(text) if k == 0 else 0) for k in range(3)]


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    """A base of one adds bytes up, so that other orders of the same bytes collide; the next base tells them apart."""
    monkeypatch.setattr(suffix_dedup, "_BASES", (1, suffix_dedup._BASES[1]))
    text = "abcdefghijklmnop" + "xy" * 20
    turned = text[:16] + "yx" * 20
    rows = [(1, text), (2, turned), (3, text)]
    ids, data = [i for i, _ in rows], [t.encode() for _, t in rows]
    shared = np.unique(np.concatenate([suffix_dedup.window_runs(x)[2] for x in data]))
    none = np.zeros(0, np.uint64)
    import pandas as pd

    posts = pd.DataFrame([p for k in range(3) for p in suffix_dedup.Segments([ids[k]], [data[k]], shared, none, none).posts(k, 1)], columns=suffix_dedup._SEGMENTS_ARROW.names)
    told = suffix_dedup.resolve(posts)
    assert {int(b) for b in told["bucket"]} <= {1, 2}
    assert 2 in {int(b) for b in told["bucket"]}
