"""Complete linkage in rounds over pairs: the clusters of one matrix, also with equal similarities, by few tables and few products."""

import numpy as np
import pytest

from tests.test_similarity import clustered
from tidemark.operators import similarity, topics


def rows(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos long, vec array<double>").repartition(4)


def by_matrix(x, threshold):
    want = {}
    for g in topics.linkage(x @ x.T, threshold):
        want |= dict.fromkeys(g, min(g))
    return want


@pytest.mark.parametrize("most", [5_000, 3, 1])
@pytest.mark.parametrize("seed", range(3))
def test_equal_similarities_give_the_clusters_of_one_matrix(spark, monkeypatch, most, seed):
    """Whole numbers, so most similarities are equal to others; in one task, in rounds, and in rounds with a component a task."""
    monkeypatch.setattr(topics, "MOST_LINKED", most)
    monkeypatch.setattr(topics, "PAIRS_A_VECTOR", 40)
    monkeypatch.setattr(topics, "ROUNDS", 2)
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng = np.random.default_rng(seed)
    x = rng.permutation(np.unique(rng.integers(-2, 3, size=(70, 4)), axis=0)).astype(float)
    got = {r["pos"]: r["cluster"] for r in topics.complete_linkage(rows(spark, x), 3.0).collect()}
    assert got == by_matrix(x, 3.0)


@pytest.mark.parametrize("seed", range(6))
def test_rounds_of_a_task_against_the_matrix(seed):
    rng = np.random.default_rng(seed)
    x = rng.permutation(np.unique(rng.integers(-2, 3, size=(120, 3 + seed % 3)), axis=0)).astype(float)
    s = x @ x.T
    a, b = np.nonzero(np.triu(s >= 2, 1))
    one = np.ones(len(a), np.int64)
    names, clusters = topics.merged(a, b, s[a, b].astype(np.float32), one, one)
    assert dict(enumerate(range(len(x)))) | dict(zip(names.tolist(), clusters.tolist(), strict=True)) == by_matrix(x, 2)


def test_rounds_write_few_tables(spark, monkeypatch):
    """Two tables a round, and the last pairs are merged in a task, however many rounds they take."""
    made, inner = [], topics.written
    monkeypatch.setattr(topics, "written", lambda df: made.append(df.columns) or inner(df))
    rng = np.random.default_rng(4)
    x = clustered(rng, 400, 8, 3, 0.3)
    s = x @ x.T
    pairs = [(int(a), int(b), float(s[a, b])) for a, b in zip(*np.nonzero(np.triu(s >= 0.3, 1)), strict=True)]
    monkeypatch.setattr(topics, "MOST_LINKED", 1_000)
    got = {r["pos"]: r["cluster"] for r in topics.linkage_rounds(spark.createDataFrame(pairs, "a long, b long, sim double")).collect()}
    assert len(pairs) > 20_000
    assert dict(enumerate(range(400))) | got == by_matrix(x, 0.3)
    print("pairs", len(pairs), "tables", len(made))
    assert len(made) < 20


def test_pairs_of_clusters_are_looked_for_by_their_means():
    """One product a pair of clusters tells which pairs of members to multiply."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(60, 16)), 10, axis=0) + rng.normal(size=(600, 16)) * 0.3
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    of = np.repeat(np.arange(0, 600, 10), 10)
    p, q = similarity._Block(of[:300], x[:300], True), similarity._Block(of[300:], x[300:], True)
    assert p.means.shape == q.means.shape == (30, 16)
    s = x.astype(np.float64) @ x.astype(np.float64).T
    for one, other, at in ((p, q, 300), (p, p, 0)):
        got = {(r["a"], r["b"]): (r["sim"], r["n"]) for r in similarity._products(one, other, -0.1).to_pylist()}
        want = {(a, b): s[a : a + 10, b : b + 10].min() for a in range(0, 300, 10) for b in range(at, at + 300, 10) if a < b}
        assert got.keys() == {k for k, v in want.items() if v >= -0.1} and 0 < len(got) < len(want)
        assert all(n == 100 and abs(sim - want[k]) < 1e-12 for k, (sim, n) in got.items())


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e20])
def test_products_of_any_lengths(scale):
    """Single precision only tells where to look; lengths beyond it are multiplied in double precision."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 7)) * scale
    x[5, 2], x[9, 0] = np.nan, np.inf
    p, q = similarity._Block(np.arange(50), x[:50], False), similarity._Block(np.arange(50, 90), x[50:], False)
    with np.errstate(invalid="ignore"):
        s = x[:50] @ x[50:].T
    threshold = float(np.nanmedian(s))
    got = {(r["a"], r["b"]) for r in similarity._products(p, q, threshold).to_pylist()}
    want = {(int(i), int(j) + 50) for i, j in zip(*np.nonzero(s >= threshold), strict=True)}
    edge = {(int(i), int(j) + 50) for i, j in zip(*np.nonzero(np.abs(s - threshold) <= 1e-12 * abs(threshold)), strict=True)}
    assert got - edge == want - edge
