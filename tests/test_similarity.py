"""Pairs of vectors by blocks around reference vectors against all pairs."""

import numpy as np
import pytest

from tidemark.operators import similarity


def clustered(rng, n, dim, places, spread):
    centres = rng.normal(size=(places, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[rng.integers(0, places, n)] + rng.normal(size=(n, dim)) * spread / np.sqrt(dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, within, x):
    return spark.createDataFrame([(w, i, v.tolist()) for i, (w, v) in enumerate(zip(within, x, strict=True))], "within string, pos long, vec array<double>").repartition(4)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.95, -0.2])
@pytest.mark.parametrize("block", [40, 5000])
def test_pairs_equal_all_pairs(spark, monkeypatch, threshold, block):
    """By blocks and as one product; other lengths than 1, a zero vector, equal vectors, and none without a group."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = np.random.default_rng(7)
    x = np.vstack([clustered(rng, 260, 24, 12, 0.4), clustered(rng, 60, 24, 60, 1.0), 1.7 * clustered(rng, 30, 24, 3, 0.2), np.zeros((1, 24))])
    x = np.vstack([x, x[:10]])
    within = [None if k % 29 == 0 else "ab"[k % 2] for k in range(len(x))]
    got = sorted((r["a"], r["b"]) for r in similarity.pairs_within(frame(spark, within, x), threshold).collect())
    s = x @ x.T
    want = [(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if within[a] and within[a] == within[b] and s[a, b] >= threshold]
    assert got == want
    assert similarity.pairs_within(frame(spark, within, x).limit(0), threshold).count() == 0


def test_most_pairs_of_clustered_vectors_are_excluded(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 64)
    rng = np.random.default_rng(3)
    tight, loose = (frame(spark, ["a"] * 3000, clustered(rng, 3000, 32, 30, spread)) for spread in (0.15, 0.5))
    shares = {(name, t): similarity.share_excluded(df, t) for name, df in (("tight", tight), ("loose", loose)) for t in (0.5, 0.9)}
    print(shares)
    assert shares["tight", 0.9] > 0.7 and shares["tight", 0.9] >= shares["tight", 0.5] > 0.2
