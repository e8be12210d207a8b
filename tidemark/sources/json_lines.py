"""JSON-lines transcripts and audit logs: tolerant reading, discovery by path, and the folds over them."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_ms
from ..operators.graph import written
from ..schema import KNOWN_LINE_TYPES, KNOWN_SENDERS

UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
TRANSCRIPT_NAME = f"/[^/]+/({UUID})\\.jsonl$"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return bool(found)


@contextmanager
def _few_listings(spark: SparkSession):
    """Folders are listed by some tasks a core. Spark's own rule is a task a folder up to 10,000, whatever the cluster's size."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def load(reader: DataFrameReader, form: str, glob: str | list[str], path: str = "_metadata.file_path") -> DataFrame | None:
    """The files that match, read by ``reader`` as ``form``; None if the folder they are looked for in isn't there or is empty.

    Of a glob with folders in it, the driver finds the folders, hidden ones too; their files are listed by tasks, once,
    and paths of another depth or shape are left out.
    """
    spark = reader._spark
    parts = glob.split("/") if isinstance(glob, str) else []
    first = next((k for k, x in enumerate(parts) if re.search(r"[*?\[{\\]", x)), len(parts))
    below = parts[first:]
    if len(below) < 2 or re.search(r"[\[{\\]", "/".join(below)):
        if isinstance(glob, str) and not exists(spark, glob):
            return None
        with _few_listings(spark):
            return reader.format(form).load(glob)
    base, top = "/".join(parts[:first]) or "/", "/".join(parts[:-1])
    if not exists(spark, top):
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(base)
    depth = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).depth() + len(below)
    shape = "".join("/" + "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in x) for x in below) + "$"
    with _few_listings(spark):
        found = reader.format(form).option("recursiveFileLookup", True).option("pathGlobFilter", below[-1]).load(top)
    levels = F.size(F.split(F.regexp_replace(F.col(path), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/")) - 1
    return found.where((levels == depth) & F.col(path).rlike(shape))


def files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, mtime_ms) of the files that match; their contents aren't read."""
    found = load(spark.read, "binaryFile", glob, "path")
    if found is None:
        return spark.createDataFrame([], "path string, mtime_ms double")
    return found.select("path", (F.unix_micros("modificationTime") / 1000.0).alias("mtime_ms"))


def read_lines(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    """(path, mtime_ms, line_no, raw) of all lines but empty ones, which count in the numbering; no rows if nothing matches.

    Files are read by splits, so a log of any size is read by many tasks. Lines get their numbers in two passes: the
    first counts the lines of each split, whose prefix sums along a file are the splits' offsets; the second adds a
    line's place within its split. Both passes have to cut files alike; where the cut has changed between them (the
    files have, or the cluster's size), a line falls out of its split's range and the job fails instead of numbering
    lines wrongly. Lines end with a line feed, with or without a carriage return before it.
    """
    found = load(spark.read.option("lineSep", "\n"), "text", glob) if glob else None
    if found is None:
        return spark.createDataFrame([], "path string, mtime_ms double, line_no long, raw string")
    split = ["path", "split_start", "split_length"]
    lines = found.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split_start"), F.col("_metadata.file_block_length").alias("split_length"), (F.unix_micros("_metadata.file_modification_time") / 1000.0).alias("mtime_ms"),
        F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("raw"),
    )
    # one row a split
    counts = written(lines.groupBy(*split).agg(F.count("*").alias("n"), F.min("at").alias("first")))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    place = F.col("at") - F.col("first")
    number = F.when((place >= 0) & (place < F.col("n")), F.col("before") + place + 1).otherwise(F.raise_error(F.lit("the files were cut into other splits than when their lines were counted; run again")))
    return lines.join(offsets, split, "left").select("path", "mtime_ms", number.cast("long").alias("line_no"), "raw").where("raw <> ''")


def parse(lines: DataFrame, strict_objects: bool = False) -> DataFrame:
    """Adds v (variant) and malformed. With ``strict_objects`` JSON that is no object is malformed too, and blank lines are left out (the drill-in reader's rule)."""
    df = lines.where(F.trim("raw") != "") if strict_objects else lines
    df = df.withColumn("v", F.try_parse_json("raw"))
    bad = F.col("v").isNull()
    if strict_objects:
        bad = bad | ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return df.withColumn("malformed", bad)


def transcript_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime_ms, file_id) of root/<dir>/<uuid>.jsonl, one level deep."""
    return files(spark, f"{root.rstrip('/')}/*/*.jsonl").withColumn("file_id", F.regexp_extract("path", TRANSCRIPT_NAME, 1)).where("file_id <> ''")


def transcripts(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """Lines of root/<dir>/<uuid>.jsonl, one level deep, with file_id; of ``paths`` only, if they are given."""
    lines = read_lines(spark, f"{root.rstrip('/')}/*/*.jsonl" if paths is None else paths)
    return lines.withColumn("file_id", F.regexp_extract("path", TRANSCRIPT_NAME, 1)).where("file_id <> ''")


AUDIT_NAME = r"/([^/]+)/audit\.jsonl$"


def audit_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime_ms, session_key) of root/*/*/<session key>/audit.jsonl."""
    return files(spark, f"{root.rstrip('/')}/*/*/*/audit.jsonl").withColumn("session_key", F.regexp_extract("path", AUDIT_NAME, 1))


def audits(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """Lines of root/*/*/<session key>/audit.jsonl, with session_key."""
    return read_lines(spark, f"{root.rstrip('/')}/*/*/*/audit.jsonl" if paths is None else paths).withColumn("session_key", F.regexp_extract("path", AUDIT_NAME, 1))


def _string(v: str, path: str) -> Column:
    """A member that is a JSON string; anything else is null (variant_get alone would convert numbers)."""
    raw = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(v, path, "string"))


def _number(v: str, path: str, kind: str = "long") -> Column:
    raw = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(raw).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(v, path, "double").cast(kind))


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def tool_calls(called: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, top_tools): how often each tool of ``called`` (key, tools: names called by a line) is called."""
    counts = called.select(key, F.explode("tools").alias("name")).groupBy(key, "name").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("top_tools"))


def ordered_distinct(df: DataFrame, key: str, value: Column, pos: str, name: str) -> DataFrame:
    """Distinct values of each key in the order in which they first appear."""
    firsts = df.select(key, value.alias("_v"), pos).where("_v IS NOT NULL").groupBy(key, "_v").agg(F.min(pos).alias("_p"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda s: s["_v"]).alias(name))


def fold_transcripts(lines: DataFrame) -> DataFrame:
    """One row a transcript: turns, times, first cwd and user text, last model and titles, distinct models in order, token sums, tools, malformed lines."""
    df = parse(lines)
    kind, ts = _string("v", "$.type"), parse_ms(_string("v", "$.timestamp"))
    content = F.try_variant_get("v", "$.message.content", "variant")
    blocks = F.try_variant_get("v", "$.message.content", "array<variant>")
    block_text = lambda b: _string_of(b, "$.text")
    usable = F.filter(blocks, lambda b: (F.coalesce(_string_of(b, "$.type"), F.lit("")) != "tool_result") & (F.length(block_text(b)) > 0))
    text = F.when(F.schema_of_variant(content) == "STRING", _filled(_string("v", "$.message.content"))).otherwise(block_text(F.get(usable, F.lit(0))))
    model = _filled(_string("v", "$.message.model"))
    tools = F.transform(F.filter(blocks, lambda b: (_string_of(b, "$.type") == "tool_use") & (F.length(_string_of(b, "$.name")) > 0)), lambda b: _string_of(b, "$.name"))
    # Columns are named before they are used, so each is computed once
    df = df.select(
        "file_id", "mtime_ms", "line_no", "malformed", F.when(kind == "assistant", tools).alias("tools"), kind.alias("kind"), ts.alias("ts"), _string("v", "$.cwd").alias("cwd"), F.when(kind == "user", text).alias("text"), F.when(kind == "assistant", model).alias("model"),
        _filled(_string("v", "$.aiTitle")).alias("title"), _filled(_string("v", "$.lastPrompt")).alias("prompt"),
        *[F.when(kind == "assistant", _number("v", f"$.message.usage.{p}")).alias(n) for n, p in (("t_in", "input_tokens"), ("t_out", "output_tokens"), ("t_new", "cache_creation_input_tokens"), ("t_read", "cache_read_input_tokens"))],
    )
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("line_no"))
    of = lambda k, c: F.when(F.col("kind") == k, F.col(c))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    # written, as three groupings follow, which would each open every file again
    df = written(df.withColumn("title", of("ai-title", "title")).withColumn("prompt", of("last-prompt", "prompt")))
    folds = df.groupBy("file_id").agg(
        F.max("mtime_ms").alias("mtime_ms"), F.count_if(F.col("kind") == "user").alias("user_turns"), F.count_if(F.col("kind") == "assistant").alias("assistant_turns"), F.min_by("cwd", at("cwd")).alias("cwd"),
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.min_by("text", at("text")).alias("first_user_text"), F.max_by("model", at("model")).alias("model"), F.max_by("title", at("title")).alias("ai_title"), F.max_by("prompt", at("prompt")).alias("last_prompt"),
        F.struct(zero("t_in")("input"), zero("t_out")("output"), zero("t_new")("cache_creation"), zero("t_read")("cache_read")).alias("token_totals"), F.count_if("malformed").alias("malformed"),
    )
    return folds.join(ordered_distinct(df, "file_id", F.col("model"), "line_no", "models_used"), "file_id", "left").join(tool_calls(df), "file_id", "left")


def _string_of(b: Column, path: str) -> Column:
    raw = F.try_variant_get(b, path, "variant")
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(b, path, "string"))


def first_texts(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, first_human_text): of the first line of type and role 'user' that has a text: its content, or the text of the first text block, also an empty one."""
    df = parse(lines)
    content, blocks = F.try_variant_get("v", "$.message.content", "variant"), F.try_variant_get("v", "$.message.content", "array<variant>")
    texts = F.filter(F.transform(F.filter(blocks, lambda b: _string_of(b, "$.type") == "text"), lambda b: _string_of(b, "$.text")), lambda s: s.isNotNull())
    text = F.when(F.schema_of_variant(content) == "STRING", _string("v", "$.message.content")).otherwise(F.get(texts, F.lit(0)))
    own = df.where((_string("v", "$.type") == "user") & (_string("v", "$.message.role") == "user")).select(key, "line_no", text.alias("text")).where("text IS NOT NULL")
    return own.groupBy(key).agg(F.min_by("text", "line_no").alias("first_human_text"))


def unknown_senders(messages: DataFrame) -> DataFrame:
    """Senders of messages (id, sender) that aren't known, each once with the first session that has it."""
    return messages.where(F.col("sender").isNotNull() & ~F.col("sender").isin(*KNOWN_SENDERS)).groupBy("sender").agg(F.min("id").alias("first_id"))


def fold_audit(lines: DataFrame, key: str = "session_key") -> DataFrame:
    """One row an audit log: turns, and sums over its result lines, null without any; distinct model keys, the last result's last key."""
    df = parse(lines)
    result = _string("v", "$.type") == "result"
    usage = F.when(result & F.schema_of_variant(F.try_variant_get("v", "$.modelUsage", "variant")).startswith("OBJECT"), F.json_object_keys(F.get_json_object("raw", "$.modelUsage")))
    numbers = {"duration_ms": "long", "duration_api_ms": "long", "num_turns": "long", "total_cost_usd": "double"}
    # written, as two groupings follow, which would each open every file again
    df = written(df.select(key, "line_no", "malformed", usage.alias("keys"), _string("v", "$.type").alias("kind"), *[F.when(result, _number("v", f"$.{n}", t)).alias(n) for n, t in numbers.items()]))
    total = lambda n: F.when(F.count_if(F.col("kind") == "result") > 0, F.coalesce(F.sum(n), F.lit(0).cast(numbers[n]))).alias(n)
    folds = df.groupBy(key).agg(
        F.count_if(F.col("kind") == "user").alias("user_turns"), F.count_if(F.col("kind") == "assistant").alias("assistant_turns"), F.count_if(F.col("kind") == "result").alias("result_lines"), total("duration_ms"), total("duration_api_ms"),
        total("num_turns"), total("total_cost_usd"), F.max_by(F.element_at("keys", -1), F.when(F.size("keys") > 0, F.col("line_no"))).alias("last_result_model"), F.count_if("malformed").alias("malformed"),
    )
    exploded = df.select(key, "line_no", F.posexplode("keys").alias("at", "k")).withColumn("at", F.struct("line_no", "at"))
    return folds.join(ordered_distinct(exploded, key, F.col("k"), "at", "model_usage_keys"), key, "left")


def unknown_line_types(lines: DataFrame) -> DataFrame:
    """Line types that the reader doesn't know, each once with the first file that has it."""
    kind = _string("v", "$.type")
    return parse(lines).select(kind.alias("type"), "path").where(F.col("type").isNotNull() & ~F.col("type").isin(*KNOWN_LINE_TYPES)).groupBy("type").agg(F.min("path").alias("first_path"))
