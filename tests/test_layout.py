"""Neighbour descent against all pairs, and the plane against principal components."""

import numpy as np

from tests.test_similarity import clustered
from tidemark.operators import layout, topics


def frame(spark, x):
    return spark.createDataFrame([(i, None if v is None else list(map(float, v))) for i, v in enumerate(x)], "doc long, vec array<double>").repartition(4)


def nearest(x, k):
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def trustworthiness(x, y, k):
    """1 if the k nearest in the plane are among the k nearest of the vectors; lower by the ranks of intruders."""
    n = len(x)
    s = x @ x.T
    np.fill_diagonal(s, np.inf)
    rank = np.argsort(np.argsort(-s, axis=1), axis=1)
    d = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, axis=1) - k, 0).sum()


def test_recall_of_neighbour_descent(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([clustered(rng, 900, 24, 12, 0.6), clustered(rng, 300, 24, 300, 1.0)])
    got = layout.neighbours(frame(spark, x).withColumnRenamed("doc", "pos"), 10).collect()
    want = {(a, int(b)) for a, row in enumerate(nearest(x, 10)) for b in row}
    recall = len({(r["a"], r["b"]) for r in got} & want) / len(want)
    print("recall", recall)
    assert recall > 0.95
    assert all(abs(r["sim"] - x[r["a"]] @ x[r["b"]]) < 1e-9 and r["a"] != r["b"] for r in got)
    assert len(got) == len(x) * 10


def test_plane_keeps_neighbours(spark):
    rng = np.random.default_rng(8)
    x = clustered(rng, 900, 32, 15, 0.5)
    docs = frame(spark, x)
    y, flat = ({r["doc"]: r["at"] for r in f(docs).collect()} for f in (layout.neighbour_plane, topics.plane))
    ours, pca = (trustworthiness(x, np.array([p[i] for i in range(len(x))]), 15) for p in (y, flat))
    print("trustworthiness", ours, "principal components", pca)
    assert ours > pca + 0.05 and ours > 0.9


def test_odd_documents(spark):
    x = [[1.0, 0.0, 0.0], [1.0, 0.0, 0.0], None, [0.0, 0.0, 0.0], [float("nan"), 1.0, 0.0], [0.0, 2.0, 0.0], [float("inf"), 0.0, 0.0], []]
    docs = frame(spark, x)
    edges = {(r["a"], r["b"]): r["sim"] for r in layout.neighbours(docs.withColumnRenamed("doc", "pos"), 5).collect()}
    assert edges == {(0, 1): 1.0, (1, 0): 1.0, (0, 5): 0.0, (5, 0): 0.0, (1, 5): 0.0, (5, 1): 0.0}
    at = {r["doc"]: r["at"] for r in layout.neighbour_plane(docs, 5, steps=3).collect()}
    assert len(at) == 8 and {d for d, p in at.items() if p is not None} == {0, 1, 5}
    assert all(np.isfinite(at[d]).all() for d in (0, 1, 5))
    assert layout.neighbour_plane(docs.limit(0)).count() == 0
    assert layout.neighbour_plane(docs.where("doc IN (0, 2)")).count() == 2
