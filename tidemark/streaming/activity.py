"""Structured Streaming over activity events, and the incremental behaviours of the pipeline."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import _folder

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """A stream over files of events (a folder or one file); ``at`` is the event time with zone."""
    # as a pattern the path may name a single file, too
    return spark.readStream.schema(schema).parquet(path[:-1] + f"[{path[-1]}]").withColumn("at", F.col("ts").cast("timestamp"))


def weekly(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Sunday weeks: events and their value by type."""
    return events.withWatermark("at", late).groupBy(F.window("at", "7 days", "7 days", "3 days").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("value"))


def fortnights(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Sliding fortnights a day apart with three events or more of a user: the density rule on unbounded input."""
    return events.withWatermark("at", late).groupBy(F.window("at", "14 days", "1 day").alias("w"), "user_id").agg(F.count("*").alias("n")).where("n >= 3")


def user_sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def once(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark; its state doesn't grow without end."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def rescan_events(lines: DataFrame) -> DataFrame:
    """A progress log (value: one JSON object a line): kind, phase and message; broken lines and drift warnings are left out."""
    v = F.try_parse_json("value")
    df = lines.withColumn("v", v).where("v IS NOT NULL").select(F.try_variant_get("v", "$.type", "string").alias("kind"), F.try_variant_get("v", "$.message", "string").alias("message"))
    phase = F.regexp_extract(F.coalesce("message", F.lit("")), r"(?i)\bphase (\d+)", 1)
    return df.where("kind IS NOT NULL").where(~F.coalesce(F.col("message").rlike("(?i)unknown (manifest key|line type|sender)"), F.lit(False))).withColumn("phase", F.when(phase != "", phase.cast("int")))


def complete_sessions(chunks: DataFrame) -> DataFrame:
    """Chunks (session, expected, sim) of a stream to one row a session, when all its chunks are there: best similarity and chunk count."""

    def step(key, parts, state):
        seen, best = state.get if state.exists else (0, float("-inf"))
        expected = 0
        for pdf in parts:
            seen, best, expected = seen + len(pdf), max(best, float(pdf["sim"].max())), int(pdf["expected"].max())
        if seen >= expected:
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "chunks": [seen], "best": [best]})
        else:
            state.update((seen, best))

    return chunks.groupBy("session").applyInPandasWithState(step, "session long, chunks long, best double", "seen long, best double", "append", "NoTimeout")


def complete_or_expired(chunks: DataFrame, wait: str = "1 day", late: str = "1 hour") -> DataFrame:
    """complete_sessions() of chunks (session, expected, sim, at) whose state ends: a session that isn't whole ``wait`` after its last chunk, by the watermark, is given as it is, with complete false, and forgotten.

    Sessions are (session, chunks, best, complete). What is held is two numbers for each session that is open.
    """
    held_ms = int(pd.Timedelta(wait).total_seconds() * 1000)

    def step(key, parts, state):
        if state.hasTimedOut:
            seen, best = state.get
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "chunks": [seen], "best": [best], "complete": [False]})
            return
        seen, best = state.get if state.exists else (0, float("-inf"))
        expected, last = 0, 0
        for pdf in parts:
            seen, best, expected = seen + len(pdf), max(best, float(pdf["sim"].max())), max(expected, int(pdf["expected"].max()))
            last = max(last, int(pdf["at"].max().timestamp() * 1000))
        if seen >= expected:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"session": [key[0]], "chunks": [seen], "best": [best], "complete": [True]})
        else:
            state.update((seen, best))
            state.setTimeoutTimestamp(max(last + held_ms, state.getCurrentWatermarkMs() + 1))

    marked = chunks.withWatermark("at", late)
    return marked.groupBy("session").applyInPandasWithState(step, "session long, chunks long, best double, complete boolean", "seen long, best double", "append", "EventTimeTimeout")


def ring(events: DataFrame, key: str = "source", size: int = 500) -> DataFrame:
    """(key, n, messages): how many events (key, pos, message) of each key there were, and its last ``size`` messages by pos, anew for each key that got some; what is held for a key never grows beyond that."""

    def step(k, parts, state):
        n, kept = (state.get[0], list(zip(state.get[1], state.get[2], strict=True))) if state.exists else (0, [])
        for pdf in parts:
            n += len(pdf)
            kept = sorted([*kept, *zip(pdf["pos"].tolist(), pdf["message"].tolist(), strict=True)])[-size:]
        pos, messages = [p for p, _ in kept], [m for _, m in kept]
        state.update((n, pos, messages))
        yield pd.DataFrame({key: [k[0]], "n": [n], "messages": [messages]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} string, n long, messages array<string>", "n long, pos array<long>, messages array<string>", "update", "NoTimeout")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and give its result as a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        # a complete result replaces the one before; appended batches have folders of their own, so a batch that runs again replaces itself
        batch.write.mode("overwrite").parquet(f"{base}/out/{'all' if mode == 'complete' else f'batch={number}'}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = f"{base}/out/all" if mode == "complete" else f"{base}/out"
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)  # without the batch's number


def flush(stream: DataFrame, path: str, every: str = "250 milliseconds"):
    """Start a stream whose whole result so far is written to ``path`` at every interval: a folder a batch, so a reader never sees half a result. latest() reads the newest; stop the returned query when drain() has the final one."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    return stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(processingTime=every).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """What the last finished interval of flush() wrote."""
    rows = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out/batch=*")
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")
