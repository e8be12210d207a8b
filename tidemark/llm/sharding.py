"""Sharding by balanced label propagation (operator 5).

Documents are linked through groups (equal texts here; any group column in general). They start in even random
shards, by a hash of doc_id and text, so how a table is cut into files doesn't matter. In each round a document wants
to move to the shard that holds most of its group; how many may go from one shard to another is a quota that keeps the
linked documents of a shard within its share, and a hash draws who goes. At the end the law is met exactly: in each
shard linked documents rank first, and the few beyond the shard's share fill the shards that lack some. As linked
documents alone never exceed a share by more than chance, these are unlinked ones wherever there are any. Only (group,
shard) counts are joined, so a group of any size is at most one row a shard there.

Results defined for odd input: a null text has no bytes (size 16, crc32 0) and no links; null and repeated
doc_ids are sharded one by one; fewer documents than shards leave shards empty; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fingerprint, materialize, read_table

SHARDS = 40
ROUNDS = 6
#: Part of an even share that linked documents may take between rounds; the rest takes what chance adds.
SLACK = 0.95
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 4


def quotas(wanted: np.ndarray, sizes: np.ndarray, capacity: float) -> np.ndarray:
    """How many may move from shard i to shard j: as many as want the other way, then what the capacity leaves."""
    allowed = np.minimum(wanted, wanted.T).astype(float)
    room = np.maximum(capacity - sizes, 0)
    more = wanted - allowed
    into = more.sum(axis=0)
    return allowed + more * np.divide(np.minimum(room, into), into, out=np.zeros(len(into)), where=into > 0)[None, :]


def _pick(values, index: Column) -> Column:
    """The entry of a short list of numbers that the index column names."""
    return F.element_at(F.array(*[F.lit(x) for x in values]), index + 1)


def propagate(linked: DataFrame, shards: int, share: float, rounds: int) -> DataFrame:
    """``linked`` (uid, group g1, g2, shard) after some rounds, at most; ``share``: linked rows that a shard may hold."""
    sizes = np.zeros(shards)
    for r in linked.groupBy("shard").count().collect():  # one row a shard
        sizes[r["shard"]] = r["count"]
    for t in range(rounds):
        counts = linked.groupBy("g1", "g2", "shard").agg(F.count("*").alias("n"))
        top = materialize(counts.groupBy("g1", "g2").agg(F.max(F.struct("n", F.xxhash64("g1", "shard").alias("tie"), "shard"))["shard"].alias("target")), "top")
        state = materialize(linked.join(top, ["g1", "g2"]).withColumn("draw", F.pmod(F.xxhash64("uid", F.lit(t)), F.lit(1 << 30)) / float(1 << 30)), "state")
        wanted = np.zeros((shards, shards))
        for r in state.where("shard <> target").groupBy("shard", "target").count().collect():  # at most shards ** 2 rows
            wanted[r["shard"], r["target"]] = r["count"]
        if not wanted.any():
            return linked
        go = quotas(wanted, sizes, max(SLACK * share, sizes.sum() / shards))
        chance = np.divide(go, wanted, out=np.zeros_like(go), where=wanted > 0)
        sizes += go.sum(axis=0) - go.sum(axis=1)
        moves = _pick(chance.ravel().tolist(), F.col("shard") * shards + F.col("target"))
        linked = state.withColumn("shard", F.when(F.col("draw") < moves, F.col("target")).otherwise(F.col("shard"))).drop("draw", "target")
    return materialize(linked, "propagated")


def settle(rows: DataFrame, shards: int) -> DataFrame:
    """Exact shares: ``rows`` (uid, linked, shard, ...) with shard and slot such that counts are at most one apart and slots gapless."""
    n = rows.count()
    buckets = max(LEAST_BUCKETS, -(-n // (shards * BUCKET_ROWS)))
    spread = rows.withColumn("bucket", F.when(F.col("linked"), 0).otherwise(buckets) + F.pmod(F.xxhash64("order", F.lit("slot")), F.lit(buckets)).cast("int"))
    counts = spread.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    have = np.zeros(shards, np.int64)
    for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row a shard
        have[r["shard"]] = r["n"]
    share = np.full(shards, n // shards)
    share[np.argsort(-have, kind="stable")[: n % shards]] += 1  # the largest shards take the odd rows
    over, lack = np.maximum(have - share, 0), np.maximum(share - have, 0)
    over_before, lack_ends = np.cumsum(over) - over, np.cumsum(lack)
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("order", "uid")
    ranked = spread.join(bases, ["shard", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)
    extra = F.col("rank") - _pick(share.tolist(), F.col("shard"))
    number = extra + _pick(over_before.tolist(), F.col("shard"))
    ends = F.array(*[F.lit(int(x)) for x in lack_ends])
    to = F.size(F.filter(ends, lambda x: x <= number))
    slot = number - _pick((lack_ends - lack).tolist(), to) + _pick(have.tolist(), to)
    moved = extra >= 0
    return ranked.select("*", F.when(moved, to).otherwise(F.col("shard")).cast("int").alias("_shard"), F.when(moved, slot).otherwise(F.col("rank")).cast("long").alias("slot")).drop("shard", "bucket", "base", "rank").withColumnRenamed("_shard", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document; law ``rows``: counts at most one apart."""
    g1, g2 = fingerprint(F.col("text"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        g1.alias("g1"), g2.alias("g2"), F.col("text").isNotNull().alias("has_text"), F.monotonically_increasing_id().alias("uid"),
    )
    rows = materialize(rows.withColumn("order", F.xxhash64("doc_id", "g1", "g2")).withColumn("shard", F.pmod(F.col("order"), F.lit(shards)).cast("int")), "shard-rows")
    groups = materialize(rows.where("has_text").groupBy("g1", "g2").agg(F.count("*").alias("members")).where("members > 1"), "groups")
    linked = materialize(rows.join(groups, ["g1", "g2"]).select("g1", "g2", "uid", "order", "doc_id", "size", "text_crc32", "shard"), "linked")
    placed = propagate(linked, shards, rows.count() / shards, rounds)
    alone = rows.join(groups, ["g1", "g2"], "left_anti")
    keep = ["uid", "order", "doc_id", "size", "text_crc32", "shard"]
    everything = materialize(placed.select(*keep, F.lit(True).alias("linked")).unionByName(alone.select(*keep, F.lit(False).alias("linked"))), "placed")
    return settle(everything, shards)


def op5_label_propagation(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
