"""Tables at rest: sinks, earlier snapshots, point reads, probes for optional results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import class_counts
from ..operators.rollups import source_counts
from ..schema import SESSION, SOURCES
from .json_lines import exists

#: Names of optional results.
RESERVED = ("duplicates.exact", "zombies.heuristic", "meta", "duplicates.semantic", "zombies.semantic", "reloops")


def write_sessions(sessions: DataFrame, path: str, sources: tuple[str, ...] = SOURCES) -> None:
    """One folder a source, so that a filter on source prunes. ``sources`` are replaced: those of them without sessions lose their folder, others keep what they have."""
    spark = sessions.sparkSession
    mine = sessions.where(F.col("source").isin(*sources))
    mine.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
    present = {r["source"] for r in mine.select("source").distinct().collect()}  # four at most
    for source in sources:
        if source not in present:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/source={source}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def all_sessions(spark: SparkSession, path: str) -> DataFrame:
    """All stored sessions, of any run; none if there are none."""
    found = previous(spark, path)
    return spark.createDataFrame([], SESSION) if found is None else found


def write_conversations(conversations: DataFrame, sessions: DataFrame, folder: str) -> None:
    """Bodies and slim records apart: queries over sessions never read messages."""
    conversations.write.mode("overwrite").parquet(f"{folder}/messages")
    write_sessions(sessions.drop("human_texts"), f"{folder}/sessions")


def write_analysis(duplicates: DataFrame, lifecycle: DataFrame, sessions: DataFrame, folder: str, generated_at: int) -> None:
    """Duplicates, lifecycle, and one row of counts."""
    duplicates.write.mode("overwrite").parquet(f"{folder}/duplicates.exact")
    lifecycle.write.mode("overwrite").parquet(f"{folder}/zombies.heuristic")
    counts = class_counts(lifecycle).groupBy().pivot("classification", ["active", "dormant", "zombie"]).agg(F.first("projects"))
    meta = sessions.agg(F.count("*").alias("sessions")).crossJoin(duplicates.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("duplicate_sessions"))).crossJoin(counts)  # one row each
    meta.withColumn("generated_at", F.lit(generated_at)).write.mode("overwrite").parquet(f"{folder}/meta")


def manifest(sessions: DataFrame, generated_at: int) -> DataFrame:
    """The head of a session table: schema version, time, counts of all four sources."""
    counts = source_counts(sessions).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("counts"))
    return counts.select(F.lit(2).alias("schema_version"), F.lit(generated_at).alias("generated_at"), "counts")


def previous(spark: SparkSession, path: str, source: str | None = None) -> DataFrame | None:
    """An earlier run's records, or None; a source reads its own folder only."""
    if not (exists(spark, f"{path}/*.parquet") or exists(spark, f"{path}/*/*.parquet")):
        return None
    df = spark.read.parquet(path)
    return df if source is None else df.where(F.col("source") == source)


def assert_shape(sessions: DataFrame) -> DataFrame:
    """Fails at run time on a record without id, source or a known source."""
    bad = F.col("id").isNull() | F.col("source").isNull() | ~F.col("source").isin(*SOURCES)
    return sessions.where(F.when(bad, F.raise_error(F.concat(F.lit("bad record: "), F.coalesce(F.col("id").cast("string"), F.lit("no id"))))).otherwise(F.lit(True)))


def one(sessions: DataFrame, source: str, id_: str) -> DataFrame:
    return sessions.where((F.col("source") == source) & (F.col("id") == id_))


def analysis_status(spark: SparkSession, folder: str) -> DataFrame:
    """(name, present) of the optional results; absent ones are no error."""
    return spark.createDataFrame([(n, exists(spark, f"{folder}/{n}*")) for n in RESERVED], "name string, present boolean")


def markdown(messages: DataFrame, key: str = "id") -> DataFrame:
    """One Markdown text a session, messages in order under their senders."""
    head = F.when(F.col("sender") == "human", "Human").when(F.col("sender") == "assistant", "Assistant").otherwise(F.col("sender"))
    part = F.concat(F.lit("## "), head, F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return messages.withColumn("part", part).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda s: s["part"]), "\n\n").alias("markdown"))


def guarded(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame | None:
    """A stored table if it is there and has these columns of these types; else None, as if it weren't there."""
    if not exists(spark, path):
        return None
    df = spark.read.parquet(path)
    return df if columns.items() <= dict(df.dtypes).items() else None


def healed(spark: SparkSession, path: str, good: Column, order: str = "completed_at") -> DataFrame | None:
    """The good rows of a stored list, in order; rows that fail are deleted from the table (an atomic switch to a new folder under ``path``)."""
    versions = f"{path}/v=*"
    if not exists(spark, versions):
        return None
    rows = spark.read.option("basePath", path).parquet(versions)
    last = rows.where(F.col("v") == rows.agg(F.max("v")).first()[0])
    bad = last.where(~F.coalesce(good, F.lit(False))).count()
    kept = last.where(good).drop("v")
    if bad:
        number = last.select("v").first()["v"]
        kept.write.parquet(f"{path}/v={number + 1}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={number}")
        kept = spark.read.parquet(f"{path}/v={number + 1}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return kept.orderBy(order)


def corpus_version(sessions: DataFrame) -> str:
    """A name for what a corpus holds, whatever its order: the sum of its rows' hashes."""
    row = sessions.agg(F.count("*").alias("n"), F.sum(F.xxhash64("source", "id", "updated_at").cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}-{row['h'] or 0}"


def current_labels(labels: DataFrame, version: str) -> DataFrame:
    """Labels (with version) that were made for this corpus; an upload changes the version, which discards them."""
    return labels.where(F.col("version") == version).drop("version")


def store_labels(labels: DataFrame, sessions: DataFrame, path: str) -> None:
    """Keep labels (id, label) of a corpus, with its version."""
    labels.select("id", "label").withColumn("version", F.lit(corpus_version(sessions))).write.mode("overwrite").parquet(path)


def csv_field(c: Column) -> Column:
    """Quoted only where a comma, a quote or a line end asks for it."""
    s = c.cast("string")
    return F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(s, F.lit("")))


def local_markdown(lines: DataFrame, key: str = "id") -> DataFrame:
    """The local variant: (key, line_no, kind, body, at) as sections with the time and kind of a line, its body quoted as code unless it is a turn."""
    head = F.concat_ws(" ", F.lit("###"), F.initcap(F.coalesce("kind", F.lit("line"))), F.concat(F.lit("("), F.col("at"), F.lit(")")))
    body = F.when(F.col("kind").isin("user", "assistant"), F.col("body")).otherwise(F.concat(F.lit("```\n"), F.col("body"), F.lit("\n```")))
    part = F.concat(head, F.lit("\n\n"), F.coalesce(body, F.lit("")))
    return lines.withColumn("part", part).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda s: s["part"]), "\n\n").alias("markdown"))


def csv_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in df.columns]).alias("value"))
