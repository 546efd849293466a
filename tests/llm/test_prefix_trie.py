"""Tries of conversation prefixes against a brute-force trie, over ranges of a few sequences up to one range."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

trie = pytest.importorskip("fieldsift.llm.prefix_trie")

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda row: [(x is not None, x) for x in row])


def brute(convs):
    nodes = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        own = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += own
    digest = lambda k, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)).encode()).hexdigest()
    return in_order((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], digest(k, m)) for k, m in nodes.items())


def by_turn(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs[c].append((role or "", text or ""))
    return convs


@pytest.mark.parametrize("range_turns,last", [(10, 10), (60, 64), (200_000, 4096)])
@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, range_turns, last):
    """A third of all conversations are equal, one is long, and most share openings."""
    random.seed(seed)
    rows = []
    for c in range(-40, 260):
        if random.random() < 0.35:
            rows += [(c, t, "u", "x y") for t in range(3)]
        else:
            rows += [(c, t, random.choice("ua"), random.choice(["a", "b c", "", "é ü"])) for t in range(random.choice([1, 2, 3, 4, 9]))]
    rows += [(999, t, "u", "x y" if t < 3 else f"t {t}") for t in range(120)]
    random.shuffle(rows)
    got = trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, SCHEMA)), range_turns, last)
    assert got.columns and in_order(got.select(COLUMNS).collect()) == brute(by_turn(rows))


def test_openings_and_rows_of_every_kind(spark):
    rows = [(0, 0, "user", "a b"), (0, 1, "assistant", "c"), (40, None, None, None), (40, 3, "user", "z"), (None, 0, "user", "gone"), (3, 1, "user", "later"), (3, None, "user", "first"), (3, 1, "user", "later")]
    rows += [(c, t, "user", f"{c} {t}") for c in (1, 2, 4, 5, 6, 7, 41, 42, 61, -3) for t in range(c % 3 + 1)]
    df = spark.createDataFrame([(*r, b"k", [0]) for r in rows], SCHEMA + ", key binary, words array<int>")
    convs = by_turn([r for r in rows if r[0] is not None])
    rebuilt = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = convs.get(base, [])[:h] + convs[c][h:]
    got = trie.prefix_trie(trie.share_openings(trie.sequences(df)))
    assert in_order(got.select(COLUMNS).collect()) == brute(rebuilt)


def test_empty_table(spark):
    assert trie.prefix_trie(trie.share_openings(trie.sequences(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_extents_against_scans():
    random.seed(1)
    values = np.array([-1] + [random.randint(0, 4) for _ in range(60)])
    table = trie.SparseTable(values)
    at, least = map(np.array, zip(*[(i, d) for i in range(61) for d in range(5)]))
    left, right = table.left(at, least), table.right(at, least)
    for i, d, a, b in zip(at.tolist(), least.tolist(), left.tolist(), right.tolist()):
        lo = hi = i
        while lo > 0 and values[lo] >= d:
            lo -= 1
        while hi < 60 and values[hi + 1] >= d:
            hi += 1
        assert (a, b) == (lo, hi)
