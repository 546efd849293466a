"""Near-duplicates where a doc_id has several texts, and where posting lists and families go by blocks, against brute force."""

import collections
import random

import pytest

minhash = pytest.importorskip("fieldsift.llm.minhash")

import corpus_pipeline  # noqa: E402


def shingles(text, k):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([" ".join(words)] if words else [])


def linked(a, b, percent):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def components(nodes, edges):
    label = {x: x for x in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def by_doc(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    found = components({i for i, _ in sets}, [(x, y) for n, (x, a) in enumerate(sets) for y, b in sets[:n] if linked(a, b, percent)])
    return sorted((str(i), len(shingles(t, k)), str(found.get(i)), i is None or found[i] == i) for i, t in rows)


def rows_that_stay(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    some = [n for n, (i, _) in enumerate(rows) if i is not None and sets[n]]
    group = components(some, [(x, y) for x in some for y in some if x < y and linked(sets[x], sets[y], percent)])
    least = {}
    for n in some:
        least[group[n]] = min(least.get(group[n], (rows[n][0],)), (rows[n][0],))
    return group, least


def text(seed, change=0, words=40):
    rng = random.Random(seed)
    out = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    for i in range(change):
        out[-1 - i] = f"x{change}"
    return " ".join(out)


A, B = text("a"), text("b")
FOUR = [(10, A), (10, B), (5, B), (12, A)]
MANY = [(random.Random(n).randint(0, 25), random.Random(n).choice([text(n % 7, n % 3), text(n % 7, n % 3, 30), "", None, "one", text(1000 + n)])) for n in range(120)]
MANY += [(None, A), (3, text("long", 0, 60_000)), (200, text("long", 1, 60_000))]


@pytest.mark.parametrize("rows", [FOUR, MANY], ids=["four", "many"])
def test_one_node_per_doc_id(spark, rows):
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == by_doc(rows, 5, 80)


@pytest.mark.parametrize("rows", [FOUR, MANY], ids=["four", "many"])
def test_the_stage_loses_no_text(spark, rows):
    """Of each group of linked texts one doc_id stays, the smallest; every other row stays."""
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, gone long")
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert out.columns == df.columns
    kept = {r.gone for r in out.collect()}
    group, least = rows_that_stay(rows, 5, 80)
    assert {n for n in range(len(rows)) if n not in group} <= kept
    stays = collections.defaultdict(set)
    for n in kept & set(group):
        assert rows[n][0] == least[group[n]][0]
        stays[group[n]].add(shingles(rows[n][1], 5))
    assert set(stays) == set(group.values()) and all(len(x) == 1 for x in stays.values())
    if rows is FOUR:
        assert kept == {0, 2}


def test_split_lists_and_families_lose_no_link(spark, monkeypatch):
    """1,200 near copies of one text whose lists and families are cut in many blocks."""
    rng = random.Random(5)
    base = text("base", 0, 120).split()
    rows = []
    for n in range(1200):
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(120)] = f"y{rng.randint(0, 300)}"
        rows.append((n, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, minhash.near_duplicates(df, 3, 85).collect()))
    sets = [shingles(t, 3) for _, t in rows]
    found = components(range(1200), [(x, y) for x in range(1200) for y in range(x) if linked(sets[x], sets[y], 85)])
    assert [(i, c) for i, _, c, _ in whole] == sorted(found.items())
    monkeypatch.setattr(minhash, "LIST_BLOCK", 100)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 200)
    assert sorted(map(tuple, minhash.near_duplicates(df, 3, 85).collect())) == whole
