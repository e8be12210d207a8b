"""Pairs below a document's k-th best don't leave the task, and the neighbours are the same."""

import numpy as np

from tests.test_layout import frame
from tests.test_similarity import clustered
from tidemark.operators import layout


def test_pairs_below_the_floor_stay_in_the_task(spark):
    x = clustered(np.random.default_rng(3), 30, 8, 4, 0.8)
    s = x @ x.T
    floor = np.sort(s - 2 * np.eye(30), axis=1)[:, -3]  # the third best
    members = spark.createDataFrame([(i // 15, i, v.tolist(), float(f)) for i, (v, f) in enumerate(zip(x, floor, strict=True))], "g long, pos long, vec array<double>, floor double")
    got = {(r["a"], r["b"]) for r in layout._group_pairs(members, 10).collect()}
    assert got == {(a, b) for a in range(30) for b in range(30) if a != b and a // 15 == b // 15 and s[a, b] >= floor[a]}


def test_floors_change_no_neighbours(spark, monkeypatch):
    docs = frame(spark, clustered(np.random.default_rng(9), 150, 12, 10, 0.7)).withColumnRenamed("doc", "pos")
    found = lambda: {(r["a"], r["b"], r["rank"], round(r["sim"], 9)) for r in layout.neighbours(docs, 4, 3).collect()}
    got, inner = found(), layout._local_join
    monkeypatch.setattr(layout, "_local_join", lambda pos, x, k, floor=None: inner(pos, x, k))
    assert got == found()
