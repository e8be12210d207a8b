"""Gaps, density and bursts of hot and odd projects against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lifecycle
from tidemark.schema import DAY_MS

SPAN = 14 * DAY_MS


def corpus(seed, n=900):
    """A project with a third of all sessions, one all within a moment, ties, long silences, times before 1970, and no project."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        project = "hot" if k % 3 == 0 else rng.choice(("moment", "a", "b", "c", None))
        start = 5 * DAY_MS + rng.randint(0, 2) if project == "moment" else rng.choice((1, 1, 1, 40)) * rng.randint(-60, 60) * DAY_MS // 4 + rng.choice((0, 0, 1, SPAN - 1))
        rows.append((f"s{k}", project, start, start + rng.randint(-5, 5) * DAY_MS, "revisit?" if rng.random() < 0.3 else "t", None, k))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, project string, started_at long, updated_at long, title string, preview string, pos long").repartition(5)


def by_project(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[6])):
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_and_density_equal_loops(spark, seed):
    rows, want = corpus(seed), {}
    for group in by_project(rows).values():
        ahead = [sum(r[2] <= x[2] <= r[2] + SPAN for x in group) for r in group]
        for k, r in enumerate(group):
            want[r[0]] = ((r[2] - group[k - 1][3]) / DAY_MS if k else None, max(ahead[k:]) >= 3, r[4] == "revisit?")
    found = lifecycle.annotate(frame(spark, rows).withColumn("_kept", F.lit(1)))
    got = {r["id"]: (r["gap_days"], r["dense_after"], r["asks"]) for r in found.collect()}
    assert got == want and "_kept" in found.columns
    assert lifecycle.annotate(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("most", [2_000, 1, 0])
def test_bursts_equal_a_greedy_loop(spark, monkeypatch, most):
    """By folding, by pointers, and by both."""
    monkeypatch.setattr(lifecycle, "MOST_FOLDED", most)
    rows, want = corpus(3), []
    for project, group in by_project(rows).items():
        i = 0
        while i < len(group):
            n = sum(x[2] <= group[i][2] + SPAN for x in group[i:])
            if n >= 3:
                want.append((str(project), group[i][2], group[i + n - 1][2], n))
            i += n if n >= 3 else 1
    got = lifecycle.bursts(frame(spark, rows)).collect()
    assert sorted((str(r["project"]), r["start"], r["end"], r["n"]) for r in got) == sorted(want)
    assert lifecycle.bursts(frame(spark, rows).limit(0)).count() == 0


def test_rounds_of_large_projects_send_no_table_through_the_driver(spark, monkeypatch):
    from tidemark.operators import lifecycle

    day = 86_400_000
    rows = spark.range(900).selectExpr("id % 2 AS project", f"id div 3 * {day} AS started_at", "id AS pos")
    folded = sorted(map(tuple, lifecycle.bursts(rows).collect()))
    monkeypatch.setattr(lifecycle, "MOST_FOLDED", 10)
    plans, keep = [], lifecycle.written
    monkeypatch.setattr(lifecycle, "written", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    found = lifecycle._jumped(lifecycle._placed(rows).where("_before = _earlier AND _within - _before >= 3").selectExpr("project", "_seg", "started_at AS start", "_end AS end", "_within - _before AS n"))
    assert sorted(map(tuple, found.collect())) == folded and len(folded) > 10
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)
