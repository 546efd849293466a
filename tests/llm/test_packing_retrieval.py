"""The retrieval of packing against brute force."""

import math

import numpy as np
import pytest

packing = pytest.importorskip("fieldsift.llm.packing")


def test_all_shared_terms_score():
    rng = np.random.default_rng(3)
    tails = [rng.integers(0, 40, rng.integers(1, 90)).astype("<u4") for _ in range(30)]
    index = packing.Bm25Shard(tails)
    mean = np.mean([len(t) for t in tails])
    df = {w: sum(w in t for t in tails) for w in range(40)}
    for seed, own in enumerate(tails):
        wanted = []
        for t in tails:
            score = 0.0
            for w in sorted({x for x in own.tolist() if df[x] > 1}):
                tf = int((t == w).sum())
                score += math.log1p((30 - df[w] + 0.5) / (df[w] + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(t) / mean))
            wanted.append(score)
        assert index.scores(seed) == pytest.approx(wanted, abs=1e-9)
