"""Spelling variants against brute force over all pairs of words, with and without split heads, and edge rows."""

import random
import zlib
from collections import Counter

import pytest
import regex

spelling = pytest.importorskip("fieldsift.llm.spelling")
from fieldsift.llm.acceptors import Acceptor  # noqa: E402


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def test_acceptor_pairs():
    random.seed(4)
    for _ in range(100):
        words = sorted({"".join(random.choice("abü") for _ in range(random.randint(0, 6))) for _ in range(40)})
        machine = Acceptor(words)
        assert machine.count[machine.start] == len(words)
        got = sorted((min(a, b), max(a, b)) for x, y in machine.one_edit_pairs() for a, b in zip(x.tolist(), y.tolist()))
        assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])]
    suffixes = Acceptor(sorted(a + b + "ation" for a in "abcdef" for b in "ghijkl"))
    assert len(suffixes.final) == 8  # minimal: all first letters lead to one state, and so do all second ones


@pytest.mark.parametrize("group_words", [2, 9, 100_000])
def test_variants_against_brute_force(spark, group_words):
    random.seed(group_words)
    counts = {}
    for _ in range(400):
        word = random.choice(["shared", "", "x"]) + "".join(random.choice("abé") for _ in range(random.randint(6, 8))) + random.choice(["tail", ""])
        counts[word] = random.choice([5, 6, 25, 30, 150, 800, 5000])
    counts |= {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "y" * 3000: 9, "y" * 3001: 50}
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    got = spelling.variants(df, group_words=group_words).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == brute(counts)


def test_documents_of_every_kind(spark):
    random.seed(8)
    vocabulary = ["".join(random.choice("abcdeÀÿ×") for _ in range(random.randint(3, 9))) for _ in range(60)]
    rows = [(i, " ".join(random.choice(vocabulary[: 5 + i % 55]) for _ in range(120)), "f") for i in range(60)]
    rows += [(1, None, "f"), (2, "", "f"), (None, "Abcdefg ABCDEFG 1abcdefg9 abcdefgÄ", "f"), (3, "Äbcdefgh " * 30_000, "f"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    counts = Counter()
    for doc_id, text, _ in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert sorted(map(tuple, spelling.spelling_variants(df).collect())) == brute(counts)
    assert spelling.spelling_variants(df.limit(0)).collect() == []
