"""Neighbour embedding (V16): approximate nearest neighbours by neighbour descent, then a plane by attraction and sampled repulsion.

Neighbour descent: a document's neighbours are likely neighbours of each other. Each round gathers, for every
document, its neighbours and a sample of those it is a neighbour of (2 k + 1 vectors at most, whatever the data), and
compares them with one another; each keeps its best k, and pairs below a document's k-th best don't leave the task. It
starts from runs of documents that lie next to one another along random directions. The layout starts from the principal components; rounds move documents towards the mean of
their neighbours and away from documents that share a random bucket with them. All of it is joins, grouping and
shuffles over edges and two numbers a document; no task holds more than a batch, a bucket or a group of 2 k + 1 vectors.
Hubs are no hot group: a document that many have as neighbour is sampled as a pivot and pre-ranked in tasks.

Results for odd input: documents whose vector is null, empty or zero, or holds null or non-finite numbers, have no
neighbours and no place (null); equal vectors are neighbours at similarity 1; ties go to the lower number; ``pos`` and
``doc`` are keys; all vectors have one length; fewer documents than k have all others as neighbours; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written
from .topics import plane

#: Neighbours of a document, most rounds of descent, random directions to start from, and the gain in summed similarity below which rounds end.
NEIGHBOURS, ROUNDS, STARTS, GAIN = 15, 10, 4, 0.0005
#: Rounds of the layout, documents that a document is pushed by in a round, and the weight of their mean push.
STEPS, PUSHED_BY, PUSH = 30, 12, 5.0
#: The curve 1 / (1 + A d^(2 B)) of a least distance of 0.1, and the longest part of a step.
A, B, LONGEST = 1.577, 0.8951, 4.0
#: What two computations of one similarity may differ by.
ROUNDING = 1e-12

_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())])


def unit_vectors(docs: DataFrame) -> DataFrame:
    """(pos, vec) of the documents that have a direction, with vectors of length 1."""
    vec = F.col("vec").cast("array<double>")
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    lengths = docs.select(F.col("pos").cast("long").alias("pos"), vec.alias("vec"), norm.alias("_n")).where("_n > 0 AND _n < double('inf')")
    return lengths.select("pos", F.transform("vec", lambda x: x / F.col("_n")).alias("vec"))


def _local_join(pos: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[np.ndarray]:
    """The best k others of each member of a small group, if they are as near as its ``floor``."""
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    k = min(k, len(pos) - 1)
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    found = [np.repeat(pos, k), pos[best].ravel(), np.take_along_axis(s, best, axis=1).ravel()]
    if floor is None:
        return found
    keep = found[2] >= np.repeat(floor, k) - ROUNDING
    return [c[keep] for c in found]


def _emit(found: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=_PAIRS)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _starts(vectors: DataFrame, k: int, seed: int) -> DataFrame:
    """Pairs of documents in runs of 2 k + 1 along a random direction."""
    size = 2 * k + 1

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vec"))
                yield pa.record_batch([*batch.columns, pa.array(x @ np.random.default_rng(seed).normal(size=x.shape[1]))], names=["pos", "vec", "key"])

    def compare(batches):
        pos, x = np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _matrix(batch.column("vec"))
            pos, x = np.concatenate([pos, batch.column("pos").to_numpy()]), new if x is None else np.concatenate([x, new])
            whole = len(pos) // size * size
            if found := [_local_join(pos[i : i + size], x[i : i + size], k) for i in range(0, whole, size)]:
                yield _emit(found)
            pos, x = pos[whole:], x[whole:]
        if len(pos) > 1:
            yield _emit([_local_join(pos, x, k)])

    keyed = vectors.mapInArrow(place, "pos long, vec array<double>, key double")
    return keyed.repartitionByRange("key", "pos").sortWithinPartitions("key", "pos").select("pos", "vec").mapInArrow(compare, "a long, b long, sim double")


def _group_pairs(members: DataFrame, k: int) -> DataFrame:
    """Pairs within the groups of ``members`` (g, pos, vec, floor) that are as near as a member's floor, read in order of g, one group held at a time."""

    def compare(batches):
        group, held = None, []

        def close():
            pos, x, floor = (np.concatenate(c) for c in zip(*held, strict=True))
            return [_local_join(pos, x, k, floor)] if len(pos) > 1 else []

        for batch in batches:
            if not batch.num_rows:
                continue
            g, pos, x, floor = batch.column("g").to_numpy(), batch.column("pos").to_numpy(), _matrix(batch.column("vec")), batch.column("floor").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1), len(g)]
            found = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if g[lo] != group and held:
                    found += close()
                    held = []
                group = g[lo]
                held.append((pos[lo:hi], x[lo:hi], floor[lo:hi]))
            if found:
                yield _emit(found)
        if held and (found := close()):
            yield _emit(found)

    return members.repartition("g").sortWithinPartitions("g").select("g", "pos", "vec", "floor").mapInArrow(compare, "a long, b long, sim double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """Each document's k nearest, each pair once. Tasks rank what they hold first, so a hub moves k rows a task."""
    once = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbours(docs: DataFrame, k: int = NEIGHBOURS, rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """(a, b, sim, rank): the ``k`` documents nearest by cosine to each of ``docs`` (pos, vec), approximately (see the tests for its recall)."""
    vectors = written(unit_vectors(docs))
    found = _starts(vectors, k, seed)
    for r in range(1, STARTS):
        found = found.unionByName(_starts(vectors, k, seed + r))
    edges = written(_best(found, k))
    total = edges.agg(F.sum("sim")).first()[0] or 0.0
    for r in range(rounds):
        sample = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("pos", F.lit(seed + r)), "pos"))
        back = edges.select(F.col("b").alias("g"), F.col("a").alias("pos")).withColumn("_r", sample).where(F.col("_r") <= k).drop("_r")
        own = vectors.select(F.col("pos").alias("g"), "pos")
        members = edges.select(F.col("a").alias("g"), F.col("b").alias("pos")).unionByName(back).unionByName(own).distinct()
        # a document's k-th best; what is below can't become one of its best
        floors = edges.where(F.col("rank") == k).select(F.col("a").alias("pos"), F.col("sim").alias("floor"))
        held = vectors.join(floors, "pos", "left").select("pos", "vec", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
        edges = written(_best(_group_pairs(members.join(held, "pos"), k).unionByName(edges.select("a", "b", "sim")), k))
        was, total = total, edges.agg(F.sum("sim")).first()[0] or 0.0
        if total - was <= GAIN * abs(total):
            break
    return edges


def weights(edges: DataFrame) -> DataFrame:
    """(a, b, w), in both directions: nearness of neighbours, relative to a document's nearest and its mean distance beyond that; joined as probabilities (u + v - u v)."""
    away = edges.select("a", "b", F.acos(F.least(F.greatest("sim", F.lit(-1.0)), F.lit(1.0))).alias("d"))
    near = away.groupBy("a").agg(F.min("d").alias("rho"), F.avg("d").alias("mean"))
    w = F.exp(-(F.col("d") - F.col("rho")) / F.greatest(F.col("mean") - F.col("rho"), F.lit(1e-6)))
    one = away.join(near, "a").select("a", "b", w.alias("w"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy("a", "b").agg((1 - F.product(1 - F.col("w"))).alias("w"))


def _clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-LONGEST)), F.lit(LONGEST))


def neighbour_plane(docs: DataFrame, k: int = NEIGHBOURS, steps: int = STEPS, seed: int = 42) -> DataFrame:
    """(doc, at: two numbers) of ``docs`` (doc: a whole number, vec): neighbours by cosine stay neighbours."""
    docs = docs.select(F.col("doc").cast("long").alias("pos"), "vec")
    edges = written(weights(neighbours(docs, k, seed=seed)))
    vectors = written(unit_vectors(docs))
    n = vectors.count()
    if n < 2:
        return docs.join(vectors.select("pos"), "pos", "left_semi").select("pos", F.array(F.lit(0.0), F.lit(0.0)).alias("at")).join(docs.select("pos"), "pos", "right").select(F.col("pos").alias("doc"), "at")
    first = written(plane(vectors.withColumnRenamed("pos", "doc")).select(F.col("doc").alias("pos"), F.col("at")[0].alias("x"), F.col("at")[1].alias("y")))
    spread = first.agg(F.greatest(F.stddev_pop("x"), F.stddev_pop("y"), F.lit(1e-9))).first()[0]
    jitter = lambda s: (F.pmod(F.xxhash64("pos", F.lit(seed + s)), F.lit(1_000_003)) / 1_000_003 - 0.5) * 0.01
    at = written(first.select("pos", (F.col("x") / spread * 4 + jitter(1)).alias("x"), (F.col("y") / spread * 4 + jitter(2)).alias("y")))
    buckets = max(n // (PUSHED_BY + 1), 1)
    dx, dy = F.col("bx") - F.col("x"), F.col("by") - F.col("y")
    d2 = dx * dx + dy * dy
    pull = F.when(d2 > 0, 2 * A * B * F.pow(d2, B - 1) / (1 + A * F.pow(d2, B))).otherwise(0.0)
    push = -2 * B / ((0.001 + d2) * (1 + A * F.pow(d2, B)))
    for t in range(steps):
        alpha = 1 - t / steps
        other = at.select(F.col("pos").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
        # edges aren't sorted: places are looked up in hash tables of a partition's documents
        drawn = edges.join(other.hint("shuffle_hash"), "b").join(at.withColumnRenamed("pos", "a").hint("shuffle_hash"), "a").groupBy(F.col("a").alias("pos"))
        pulls = drawn.agg((F.sum(F.col("w") * _clipped(pull * dx)) / F.sum("w")).alias("px"), (F.sum(F.col("w") * _clipped(pull * dy)) / F.sum("w")).alias("py"))
        bucket = lambda c, t=t: F.pmod(F.xxhash64(c, F.lit(seed + t)), F.lit(buckets))
        met = at.withColumn("g", bucket("pos")).join(other.withColumn("g", bucket("b")), "g").where("pos <> b")
        pushes = met.groupBy("pos").agg(F.avg(_clipped(push * dx)).alias("qx"), F.avg(_clipped(push * dy)).alias("qy"))
        moved = at.join(pulls, "pos", "left").join(pushes, "pos", "left")
        step = lambda c, p, q, alpha=alpha: (F.col(c) + alpha * (F.coalesce(p, F.lit(0.0)) + PUSH * F.coalesce(q, F.lit(0.0)))).alias(c)
        at = written(moved.select("pos", step("x", "px", "qx"), step("y", "py", "qy")))
    placed = at.select("pos", F.array("x", "y").alias("at"))
    return docs.select("pos").join(placed, "pos", "left").select(F.col("pos").alias("doc"), "at")
