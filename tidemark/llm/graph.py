"""Connected components of a large graph by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _star(near: DataFrame, rows: int) -> DataFrame:
    """Every neighbour of a vertex next to the least vertex around it. The minima are a table of their own: one row a vertex, so adaptive execution splits a hub's rows on the other side."""
    least = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", rows)
    return near.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each vertex of ``edges`` (a long, b long) but the roots themselves; root is the least vertex of its component.

    The rounds end when nothing changes, after about the logarithm of the longest path; each is written to the
    shared folder, so no lineage grows.
    """
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    now = materialize(edges.where("a <> b").select(*ordered(F.col("a"), F.col("b"))).distinct(), "edges", edges.count())
    state = _state(now)
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = materialize(_star(both, state[0]).where("v > u AND m <> v").select(*ordered(F.col("m"), F.col("v"))).distinct(), "large-star", state[0])
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = _star(down, state[0]).select(F.explode(F.array("u", "v")).alias("x"), "m").where("x <> m").select(*ordered(F.col("m"), F.col("x"))).distinct()
        old, now = now, materialize(small, "small-star", state[0])
        drop_table(old), drop_table(large)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("b").alias("v"), F.col("a").alias("root"))
