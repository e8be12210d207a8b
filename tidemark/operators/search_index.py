"""Literal search by an index: posting lists of three-character runs, intersected, then verified.

What is indexed is what search.matches() looks at: the lower-cased text columns, names of tools and used models. Two
end marks follow each text, so every character begins a run, and queries of one or two characters are the runs they
begin. Sessions are numbered; a posting is one run in one block of BLOCK sessions with the ascending places of the
sessions that have it, so a run that all sessions have is as many postings as there are blocks, and no group grows
beyond a block. A task cuts a batch of sessions at a time and gives the places of each run as a list, so a block's
posting may be stored in parts, one a batch. Postings are sorted by run, so a query reads the row groups of its runs;
sessions are stored by block, so only blocks with candidates are read. Several queries read the sessions once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import written
from .search import matches

#: Bits of a session's place within its block.
BLOCK_BITS = 16
RUN = 3
_END = "\x01"
TEXTS = ("title", "summary", "preview", "cwd", "project")


def _texts(columns, tools: str | None, models: str | None) -> Column:
    """All searchable texts of a row, lower-cased."""
    parts = [F.array(*[F.lower(c) for c in columns])]
    parts += [F.coalesce(F.transform(c, F.lower), F.array().cast("array<string>")) for c in ([F.map_keys(tools)] if tools else []) + ([F.col(models)] if models else [])]
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: x != ""))


#: Characters of a batch whose runs are held at once; a longer text is held alone.
HELD = 4_000_000


def _postings(block: np.ndarray, at: np.ndarray, texts: pa.ListArray) -> pa.RecordBatch:
    """(run, _block, places) of some sessions in the order of their numbers: a run is one number of three characters."""
    of = pc.list_parent_indices(texts).to_numpy()
    coded = texts.flatten().dictionary_encode()
    which = coded.indices.to_numpy()
    # every different text and its end marks, one after the other, as characters; begins: where a run does
    chars = np.frombuffer("".join(t + _END * (RUN - 1) for t in coded.dictionary.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = pc.utf8_length(coded.dictionary).to_numpy().astype(np.int64)
    first = np.cumsum(size) - size
    begins = np.arange(size.sum()) + np.repeat(np.arange(len(size)) * (RUN - 1), size)
    runs, key = np.unique(chars[begins] << 42 | chars[begins + 1] << 21 | chars[begins + 2], return_inverse=True)
    key = key.astype(np.uint16 if len(runs) <= 1 << 16 else np.int64)  # short keys are sorted by counting
    # the runs of every session
    n = size[which]
    key, row = key[np.arange(n.sum()) + np.repeat(first[which] - (np.cumsum(n) - n), n)], np.repeat(of, n)
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[new], row[new]
    b, place = block[row], at[row]
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (b[1:] != b[:-1])]))
    heads = runs[key[starts]]
    names = np.stack([heads >> 42, heads >> 21 & 0x1FFFFF, heads & 0x1FFFFF], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
    lists = pa.ListArray.from_arrays(np.append(starts, len(key)).astype(np.int32), pa.array(place.astype(np.int32)))
    return pa.record_batch([pa.array([names[i : i + RUN] for i in range(0, len(names), RUN)], pa.string()), pa.array(b[starts]), lists], names=["run", "_block", "places"])


def _cut(batches):
    for batch in batches:
        order = np.lexsort((batch.column("at").to_numpy(), batch.column("_block").to_numpy()))
        block, at, texts = (batch.column(c).take(pa.array(order)) for c in ("_block", "at", "texts"))
        block, at = block.to_numpy(), at.to_numpy()
        sizes = np.zeros(len(texts), np.int64)
        np.add.at(sizes, pc.list_parent_indices(texts).to_numpy(), pc.utf8_length(texts.flatten()).to_numpy())
        held = np.cumsum(sizes) // HELD
        edges = [0, *(np.flatnonzero(np.diff(held)) + 1), len(held)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if sizes[lo:hi].any():
                yield _postings(block[lo:hi], at[lo:hi], texts.slice(lo, hi - lo))


def write(sessions: DataFrame, folder: str, columns=TEXTS, tools: str | None = "top_tools", models: str | None = "models_used") -> None:
    """Store ``sessions`` and their postings under ``folder``; extra columns are stored too, names _n and _block are the index's own."""
    spark = sessions.sparkSession
    numbered = sessions.select(F.struct(*[F.col(f"`{c}`") for c in sessions.columns]).alias("row"), F.monotonically_increasing_id().alias("_n")).withColumn("_block", F.shiftright("_n", BLOCK_BITS))
    numbered.write.mode("overwrite").partitionBy("_block").parquet(f"{folder}/rows")
    stored = spark.read.schema(numbered.schema).parquet(f"{folder}/rows")
    if stored.isEmpty():
        spark.createDataFrame([], numbered.schema).write.mode("overwrite").parquet(f"{folder}/rows")  # a folder by block holds no file, and no schema
    place = F.col("_n").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    texts = stored.select(F.col("_block").cast("long").alias("_block"), place.alias("at"), "row.*").select("_block", "at", F.transform(_texts(columns, tools, models), F.make_valid_utf8).alias("texts"))
    # written, as dealing out by ranges reads its input twice
    postings = written(texts.mapInArrow(_cut, "run string, _block long, places array<int>"))
    postings.repartitionByRange("run", "_block").sortWithinPartitions("run", "_block").write.mode("overwrite").parquet(f"{folder}/postings")


def candidates(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """(_block, at) of the sessions that have every run of the query, which isn't empty."""
    q = query.strip().lower()
    postings = spark.read.parquet(f"{folder}/postings")
    if len(q) < RUN:
        return postings.where(F.col("run").startswith(q)).select("_block", F.explode("places").alias("at")).distinct()
    runs = sorted({q[i : i + RUN] for i in range(len(q) - RUN + 1)})
    # the parts of a run's posting in a block hold different sessions
    whole = postings.where(F.col("run").isin(*runs)).groupBy("_block", "run").agg(F.flatten(F.collect_list("places")).alias("places"))
    blocks = whole.groupBy("_block").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(runs))
    both = F.aggregate(F.slice("lists", 2, len(runs)), F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b)) if len(runs) > 1 else F.get("lists", F.lit(0))
    return blocks.select("_block", F.explode(both).alias("at"))


def search(spark: SparkSession, folder: str, query: str, columns=TEXTS, tools: str | None = "top_tools", models: str | None = "models_used") -> DataFrame:
    """The stored sessions that matches() finds, which it is asked about candidates only; an empty query finds all."""
    return search_all(spark, folder, [query], columns, tools, models).select("row.*")


def search_all(spark: SparkSession, folder: str, queries: list[str], columns=TEXTS, tools: str | None = "top_tools", models: str | None = "models_used") -> DataFrame:
    """(query, row: the stored session) of what search() finds for each of ``queries``; sessions are read and joined once, however many queries there are."""
    rows = spark.read.parquet(f"{folder}/rows")
    near = None
    for k, q in enumerate(queries):
        if q.strip():
            one = candidates(spark, folder, q).select("_block", (F.shiftleft(F.col("_block").cast("long"), BLOCK_BITS) + F.col("at")).alias("_n"), F.lit(k).alias("_q"))
            near = one if near is None else near.unionByName(one)
    every = all(not q.strip() for q in queries)
    if not every:
        asked = near.groupBy("_block", "_n").agg(F.collect_list("_q").alias("_asked"))
        rows = rows.join(asked, ["_block", "_n"], "inner" if all(q.strip() for q in queries) else "left")
    inner = ([f"row.{c}" for c in columns], f"row.{tools}" if tools else None, f"row.{models}" if models else None)
    asks = lambda k: F.coalesce(F.array_contains("_asked", F.lit(k)), F.lit(False))
    hits = [F.when(asks(k) & matches(q, *inner) if q.strip() else F.lit(True), F.lit(q)) for k, q in enumerate(queries)]
    return rows.select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("query"), "row")


def share_read(spark: SparkSession, folder: str, query: str) -> float:
    """The candidates' share of all sessions."""
    every = spark.read.parquet(f"{folder}/rows").count()
    return candidates(spark, folder, query).count() / max(every, 1)
