"""The batch build: scan the sources, merge, price, validate, analyse, write tables."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cost, duplicates, lifecycle, merge, sessions
from ..operators.graph import written
from ..schema import SESSION
from ..sources import archives, json_lines, manifests, tables

REPORT = "kind string, name string, n long, first_path string"


@dataclass
class Sources:
    """Where to look; what is None is left out. ``earlier``: stored sessions whose desktop ones stand for manifests where ``desktop`` is None."""

    transcripts: str | None = None
    cowork: str | None = None
    desktop: str | None = None
    conversations: str | None = None
    projects: str | None = None
    audits: str | None = None
    earlier: str | None = None

    def scanned(self) -> tuple[str, ...]:
        """The sources whose sessions a build replaces."""
        desktop = self.desktop or (self.transcripts and self.earlier)
        return tuple(s for s, given in (("cloud", self.conversations), ("cowork", self.cowork), ("cli-direct", self.transcripts), ("cli-desktop", desktop)) if given)


@dataclass
class Scan:
    """What a scan found: (part, sessions) pairs, first human texts, and rows of the report."""

    parts: list[tuple[str, DataFrame]] = field(default_factory=list)
    texts: list[DataFrame] = field(default_factory=list)
    report: list[DataFrame] = field(default_factory=list)

    def note(self, kind: str, name, rows: DataFrame, path: str | None = None) -> None:
        """Count ``rows`` by name; ``path`` is a column whose least value is given with the count."""
        first = F.min(path) if path else F.lit(None).cast("string")
        named = F.lit(name) if isinstance(name, str) else name
        self.report.append(rows.groupBy(F.lit(kind).alias("kind"), named.alias("name")).agg(F.count("*").alias("n"), first.alias("first_path")))


def _shaped(df: DataFrame, pos: int) -> DataFrame:
    """All session columns in order, missing ones null, and a position for ties."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SESSION.fields], (F.lit(pos) + F.lit(0)).alias("pos"))


def split_changed(now: DataFrame, last: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """(sessions of the last run that are still good, files to read again) of ``now`` (source, raw_session_id, source_mtime_ms, ...): key and time decide."""
    if last is None:
        return None, now
    keys = ["source", "raw_session_id"]
    good, _ = merge.reusable(now, last, keys)
    good = written(good)
    return good, now.join(good.select(*keys), keys, "left_anti")


def _paths(files: DataFrame) -> list[str]:
    """Paths to read; as many as the file index, which lists them for every read, holds on the driver anyway."""
    return sorted(r["path"] for r in files.select("path").distinct().collect())


def _scan_cowork(spark: SparkSession, src: Sources, last: DataFrame | None, out: Scan) -> None:
    """A manifest's time decides whether its session is taken from the last run; only audit logs of the others are read."""
    every = written(manifests.read_manifests(spark, src.cowork).drop("v")).withColumn("v", F.try_parse_json("raw"))
    found = manifests.valid(every, manifests.COWORK_REQUIRED).withColumns({"source": F.lit("cowork"), "raw_session_id": F.coalesce("cli_session_id", "id"), "source_mtime_ms": F.col("mtime_ms")})
    good, again = split_changed(found, last)
    again = written(again)
    paths = None
    if good is not None:
        out.parts.append(("cowork", _shaped(good, 0)))
        out.note("reused", "cowork", good)
        paths = _paths(json_lines.audit_files(spark, src.audits or src.cowork).join(again.select("session_key"), "session_key", "left_semi"))
    lines = json_lines.audits(spark, src.audits or src.cowork, paths)
    folds = written(json_lines.fold_audit(lines))
    out.parts.append(("cowork", _shaped(sessions.from_cowork(again, folds), 0)))
    out.note("read", "cowork", again)
    out.report.append(folds.where("malformed > 0").agg(F.lit("malformed lines").alias("kind"), F.lit("cowork").alias("name"), F.coalesce(F.sum("malformed"), F.lit(0)).alias("n"), F.lit(None).cast("string").alias("first_path")).where("n > 0"))
    own = json_lines.first_texts(lines, "session_key").join(again.select("session_key", "raw_session_id"), "session_key")
    out.texts.append(own.select(F.lit("cowork").alias("source"), "raw_session_id", "first_human_text"))
    fresh = every.join(again.select("path"), "path", "left_semi")
    out.note("unknown manifest member", F.col("key"), manifests.drift(fresh), "first_path")
    out.note("refused manifest", "cowork", every.join(found.select("path"), "path", "left_anti"), "path")


def _stored_desktop(spark: SparkSession, src: Sources) -> DataFrame | None:
    """Desktop sessions of an earlier run; None if there is none, or if it is no session table."""
    stored = tables.previous(spark, src.earlier) if src.earlier and not src.desktop else None
    if stored is None or not {"source", "id", "raw_session_id", "title", "cwd", "model"} <= set(stored.columns):
        return None
    return stored.where("source = 'cli-desktop'")


def _desktop(spark: SparkSession, src: Sources) -> DataFrame | None:
    """Desktop manifests (cli_session_id, id, title, cwd, model): from their files, else from stored sessions; None without either, and then all transcripts are direct ones."""
    if src.desktop:
        return manifests.valid(manifests.read_manifests(spark, src.desktop), manifests.DESKTOP_REQUIRED)
    stored = _stored_desktop(spark, src)
    return None if stored is None else stored.groupBy(F.col("raw_session_id").alias("cli_session_id")).agg(F.min(F.struct("id", "title", "cwd", "model")).alias("m")).select("cli_session_id", "m.*")


def _scan_transcripts(spark: SparkSession, src: Sources, desktop: DataFrame | None, last: DataFrame | None, out: Scan) -> None:
    """A transcript's time decides; it is the desktop's if there is a manifest for it, and then the last run's session of that source counts."""
    now = json_lines.transcript_files(spark, src.transcripts).select("path", F.col("file_id").alias("raw_session_id"), F.col("mtime_ms").alias("source_mtime_ms"))
    if desktop is None:
        now = now.withColumn("source", F.lit("cli-direct"))
    else:
        known = desktop.select(F.col("cli_session_id").alias("raw_session_id"), F.lit("cli-desktop").alias("source")).distinct()
        now = now.join(known, "raw_session_id", "left").withColumn("source", F.coalesce("source", F.lit("cli-direct")))
    now = written(now)
    good, again = split_changed(now, last)
    paths = None
    if good is not None:
        out.parts.append(("cli-direct", _shaped(good, 2)))
        out.note("reused", F.col("source"), good)
        paths = _paths(again)
    lines = json_lines.transcripts(spark, src.transcripts, paths)
    folds = written(json_lines.fold_transcripts(lines))
    out.parts.append(("cli-direct", _shaped(sessions.from_transcripts(folds, desktop), 2)))
    out.note("read", F.col("source"), again)
    out.report.append(folds.agg(F.lit("malformed lines").alias("kind"), F.lit("transcripts").alias("name"), F.coalesce(F.sum("malformed"), F.lit(0)).alias("n"), F.lit(None).cast("string").alias("first_path")).where("n > 0"))
    out.note("unknown line type", F.col("type"), json_lines.unknown_line_types(lines), "first_path")
    stored = _stored_desktop(spark, src)
    if stored is not None:
        out.parts.append(("cli-desktop", _shaped(stored.join(now.select("raw_session_id"), "raw_session_id", "left_anti"), 1)))
    own = json_lines.first_texts(lines)
    out.texts += [own.select(F.lit(s).alias("source"), F.col("file_id").alias("raw_session_id"), "first_human_text") for s in ("cli-direct", "cli-desktop")]


def _scan_cloud(spark: SparkSession, src: Sources, out: Scan) -> None:
    talks = archives.read_conversations(spark, src.conversations)
    found = sessions.from_conversations(talks)
    if src.projects:
        # only names match; an untitled conversation has none
        named = found.withColumns({"_name": F.when(F.col("title_source") == "cloud-name", F.col("title")), "_said": F.when(F.col("title_source") == "cloud-name", F.col("summary"))}).drop("project")
        found = sessions.match_projects(named, archives.project_names(spark, src.projects), "_name", "_said")
    out.parts.append(("cloud", _shaped(found, 3)))
    said = F.get(F.filter("chat_messages", lambda m: (m["sender"] == "human") & (F.length(m["text"]) > 0)), F.lit(0))["text"]
    out.texts.append(talks.select(F.lit("cloud").alias("source"), F.col("uuid").alias("raw_session_id"), said.alias("first_human_text")))
    out.report.append(sessions.skipped(talks).select(F.lit("skipped conversations").alias("kind"), F.lit("cloud").alias("name"), F.col("skipped").alias("n"), F.lit(None).cast("string").alias("first_path")).where("n > 0"))
    senders = talks.select(F.col("uuid").alias("id"), F.explode("chat_messages").alias("m")).select("id", "m.sender")
    out.note("unknown sender", F.col("sender"), json_lines.unknown_senders(senders))


def scan(spark: SparkSession, src: Sources, out: str | None = None) -> Scan:
    """Every source that is given. Records of the last run under ``out`` are taken again where a file's time hasn't changed."""
    found = Scan()
    last = tables.previous(spark, f"{out}/sessions") if out else None
    desktop = _desktop(spark, src)
    if src.cowork:
        _scan_cowork(spark, src, last, found)
    if src.desktop:
        found.parts.append(("cli-desktop", _shaped(sessions.desktop_stubs(desktop), 1)))
        fresh = manifests.read_manifests(spark, src.desktop)
        found.note("unknown manifest member", F.col("key"), manifests.drift(fresh, manifests.DESKTOP_KNOWN_KEYS), "first_path")
        if not src.transcripts and last is not None:
            # what transcripts told the last run about sessions that still have a manifest
            kept = last.where("source = 'cli-desktop' AND source_mtime_ms IS NOT NULL").join(desktop.select("id"), "id", "left_semi")
            found.parts.append(("cli-desktop", _shaped(kept, 1)))
    if src.transcripts:
        _scan_transcripts(spark, src, desktop, last, found)
    if src.conversations:
        _scan_cloud(spark, src, found)
    return found


def first_texts(new: list[DataFrame], known: DataFrame | None) -> DataFrame | None:
    """(source, raw_session_id, first_human_text) of this run and, for what it didn't read, of earlier ones; of several texts of a key the least."""
    if not new:
        return known
    both = new[0]
    for more in new[1:]:
        both = both.unionByName(more)
    both = both.where("first_human_text IS NOT NULL").groupBy("source", "raw_session_id").agg(F.min("first_human_text").alias("first_human_text"))
    return both if known is None else both.unionByName(known.join(both, ["source", "raw_session_id"], "left_anti"))


def merged(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """One record a session: the richest of its key, priced."""
    best = merge.merge_sources(*parts)
    priced = cost.price(best.drop("cost_estimated_usd", "cost_is_estimate", "cost_breakdown"))
    return priced.drop("unknown_model")


def labelled(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Sessions under the stored labels, if these were made for this corpus; else the labels are discarded."""
    stored = tables.previous(spark, path)
    if stored is None:
        return df
    current = written(tables.current_labels(stored, tables.corpus_version(df)))
    if current.isEmpty():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        return df
    return sessions.overlay_labels(df, current)


def analyse(spark: SparkSession, df: DataFrame, texts: DataFrame | None, out: str, now: int) -> None:
    """Exact duplicates by first human text (``texts``: source, raw_session_id, first_human_text; without one the preview), and the lifecycle of inferred projects."""
    ordered = df.withColumn("_p", sessions.infer_project(F.col("project"), F.col("cwd"), F.col("title"))).withColumn("pos", F.xxhash64("source", "id"))
    said = ordered.select("source", "raw_session_id", "id", "pos", "preview")
    if texts is not None:
        said = said.join(texts, ["source", "raw_session_id"], "left").withColumn("preview", F.coalesce("first_human_text", "preview"))
    found = duplicates.exact_clusters(said, "preview")
    named = ordered.where("_p IS NOT NULL").withColumns({"project": F.col("_p.id"), "display_name": F.col("_p.id"), "inference_source": F.col("_p.inference_source")})
    tables.write_analysis(found, lifecycle.project_records(named, now).drop("first_pos"), df, out, now)


def _store_head(spark: SparkSession, out: str, now: int) -> None:
    """The manifest says what the table holds, also of sources that this run left alone."""
    tables.manifest(tables.all_sessions(spark, f"{out}/sessions"), now).write.mode("overwrite").parquet(f"{out}/manifest")


def empty(spark: SparkSession, out: str, now: int) -> None:
    """An output folder without sessions: the manifest alone."""
    _store_head(spark, out, now)


def build(spark: SparkSession, src: Sources, out: str, now: int, progress: Callable[[str], None] | None = None) -> DataFrame:
    """The whole build; gives the validation errors (none: valid), after everything is written.

    ``progress`` gets one JSON object for each phase that ends: phase, n, ms. Tables: sessions, first_texts, manifest,
    report (what was reused, read, malformed, skipped, refused or unknown) and analysis.
    """
    began = time.monotonic()

    def tell(phase: str, n: int | None = None) -> None:
        if progress:
            progress(json.dumps({"phase": phase, "n": n, "ms": round((time.monotonic() - began) * 1000)}))

    found = scan(spark, src, out)
    if not found.parts:
        raise ValueError("no source is given")
    tell("scan")
    # read the last run's rows before its tables are replaced
    done = written(merged(found.parts))
    tell("merge", done.count() if progress else None)
    texts = first_texts(found.texts, tables.previous(spark, f"{out}/first_texts"))
    texts = None if texts is None else written(texts)
    report = spark.createDataFrame([], REPORT)
    for rows in found.report:
        report = report.unionByName(rows.select("kind", "name", F.col("n").cast("long").alias("n"), "first_path"))
    report.coalesce(1).write.mode("overwrite").parquet(f"{out}/report")
    tables.write_sessions(done, f"{out}/sessions", src.scanned())
    if texts is not None:
        texts.write.mode("overwrite").parquet(f"{out}/first_texts")
    _store_head(spark, out, now)
    tell("write")
    whole = tables.all_sessions(spark, f"{out}/sessions")
    analyse(spark, labelled(spark, whole, f"{out}/labels"), texts, f"{out}/analysis", now)
    tell("analyse")
    return merge.validation_errors(done)


def reanalyse(spark: SparkSession, out: str, now: int) -> None:
    """The analysis of what was built before; records of an older schema are priced first."""
    df = tables.all_sessions(spark, f"{out}/sessions")
    if "cost_is_estimate" not in df.columns:
        df = cost.price(df).drop("unknown_model")
    analyse(spark, labelled(spark, df, f"{out}/labels"), tables.previous(spark, f"{out}/first_texts"), f"{out}/analysis", now)
