"""Scores of a shard against BM25 term by term, with terms that many tails hold, and the search for unsafe spaces."""

import itertools
import re

import numpy as np
import pytest

from fieldsift.llm import chunks
from fieldsift.llm.packing import K1, B, Bm25Shard


def test_scores_equal_every_term():
    rng = np.random.default_rng(4)
    tails = [np.minimum(rng.geometric(0.03, rng.integers(1, 90)), 200).astype("<u4") for _ in range(70)] + [np.array([5], "<u4"), np.array([9999], "<u4")]
    shard = Bm25Shard(tails)
    assert 0 < len(shard.rows) < len(shard.terms)
    mean = np.mean([len(t) for t in tails])
    held = [set(t.tolist()) for t in tails]
    for seed in range(len(tails)):
        want = np.zeros(len(tails))
        for term in held[seed]:
            df = sum(term in h for h in held)
            if df > 1:
                for i, t in enumerate(tails):
                    tf = (t == term).sum()
                    want[i] += np.log1p((len(tails) - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean))
        assert shard.scores(seed) == pytest.approx(want, abs=1e-9)


def test_unsafe_spaces():
    plain = re.compile(r"(?:\A|\s) | (?:\s|\Z)")
    assert chunks._ODD.pattern.startswith(" ")
    for n in range(7):
        for text in map("".join, itertools.product(" \n a", repeat=n)):
            assert bool(chunks._ODD.search(text)) == bool(plain.search(text))
