"""Complete linkage at falling levels: the clusters of one matrix from a share of the pairs."""

import numpy as np
import pytest

from tests.test_similarity import clustered
from tidemark.operators import similarity, topics


def rows(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos long, vec array<double>").repartition(4)


@pytest.mark.parametrize("most", [40, 3])
def test_levels_give_the_clusters_of_one_matrix_from_fewer_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(topics, "MOST_LINKED", most)
    monkeypatch.setattr(topics, "FIRST_PAIRS", 1)
    monkeypatch.setattr(similarity, "BLOCK", 50)
    rng = np.random.default_rng(11)
    x = clustered(rng, 300, 8, 20, 0.8)
    given, inner = [], topics.linkage_rounds

    def counted(pairs):
        given.append(pairs.count())
        return inner(pairs)

    monkeypatch.setattr(topics, "linkage_rounds", counted)
    got = {r["pos"]: r["cluster"] for r in topics.complete_linkage(rows(spark, x), 0.2).collect()}
    s = x @ x.T
    want = {}
    for g in topics.linkage(s, 0.2):
        want |= dict.fromkeys(g, min(g))
    assert got == want
    every = int((s[np.triu_indices(300, 1)] >= 0.2).sum())
    print("pairs of the rounds", given, "at the threshold", every)
    assert sum(given) < every / 2


@pytest.mark.parametrize("block", [7, 5000])
def test_pairs_of_clusters_are_the_least_of_all_pairs_of_members(spark, monkeypatch, block):
    """Also of clusters that lie over several blocks."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = clustered(rng, 120, 6, 10, 0.9)
    of = np.arange(120) // 9 * 9
    of[100:] = np.arange(100, 120)
    members = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(of, x, strict=True))], "pos long, cluster long, vec array<double>").repartition(3)
    got = {(r["a"], r["b"]): r["sim"] for r in similarity.cluster_pairs(members, -0.3).collect()}
    s, names = x @ x.T, sorted(set(of.tolist()))
    low = {(a, b): s[np.ix_(of == a, of == b)].min() for a in names for b in names if a < b}
    want = {k: v for k, v in low.items() if v >= -0.3}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
