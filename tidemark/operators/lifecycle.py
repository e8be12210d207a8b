"""Project lifecycle: active, dormant or zombie, and bursts of activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DAY_MS, PROBE
from .graph import written

ACTIVE_DAYS, SILENT_DAYS, GAP_DAYS, WINDOW_DAYS, DENSE = 30, 180, 60, 14, 3


_SPAN = WINDOW_DAYS * DAY_MS


def _segment() -> Column:
    """The fortnight that a start lies in; a window from it ends in the next one."""
    return F.floor(F.col("started_at") / float(_SPAN)).cast("long")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows (project, started_at, pos, ...) with ``_seg`` and, counted in their project: how many start no later than a fortnight after them (``_within``, of this segment and the next), the last of these starts (``_end``), and how many of their segment are before them (``_before``) and start before them (``_earlier``).

    A segment's group also holds the starts of the segment after it, so a project's rows are spread over as many groups
    as it has fortnights. All frames grow, so each costs one pass.
    """
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), "project", "started_at", "pos", _segment().alias("_seg"))
    after = own.select(F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), "project", "started_at", F.lit(None).cast(own.schema["pos"].dataType).alias("pos"), (F.col("_seg") - 1).alias("_seg"))
    group = Window.partitionBy("project", "_seg")
    starts = group.orderBy("started_at")
    upto = starts.rangeBetween(Window.unboundedPreceding, _SPAN)
    both = own.unionByName(after).withColumns({
        "_within": F.count("*").over(upto), "_end": F.max("started_at").over(upto), "_earlier": F.count("*").over(starts.rangeBetween(Window.unboundedPreceding, -1)), "_before": F.row_number().over(group.orderBy("started_at", "pos")) - 1,
    })
    return both.where("_row IS NOT NULL")


def annotate(sessions: DataFrame, probe: str = PROBE) -> DataFrame:
    """Sessions (project, started_at, updated_at, title, preview, pos) with the gap before each, whether it asks after the project, and whether a dense fortnight follows.

    Groups are fortnights of a project; what one needs of the others (the last update before it, whether any later one
    is dense) comes from a table of one row a fortnight.
    """
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("preview", F.lit("")))
    group = Window.partitionBy("project", "_seg")
    order, back = group.orderBy("started_at", "pos"), group.orderBy(F.desc("started_at"), F.desc("pos"))
    dense = F.col("_within") - F.col("_earlier") >= DENSE
    near = _placed(sessions).withColumns({"_prior": F.lag("_row.updated_at").over(order), "_first": F.col("_before") == 0, "_dense": dense})
    near = written(near.withColumn("_later", F.max("_dense").over(back.rowsBetween(Window.unboundedPreceding, 0))).select("_row", "project", "_seg", "_first", "_prior", "_later"))
    last = F.max_by("_row.updated_at", F.struct("_row.started_at", "_row.pos"))
    segments = near.groupBy("project", "_seg").agg(last.alias("_last"), F.max("_later").alias("_any"))
    along = Window.partitionBy("project")
    carried = segments.select("project", "_seg", F.lag("_last").over(along.orderBy("_seg")).alias("_carry"), F.max("_any").over(along.orderBy(F.desc("_seg")).rowsBetween(Window.unboundedPreceding, -1)).alias("_next"))
    same = near["project"].eqNullSafe(carried["project"]) & (near["_seg"] == carried["_seg"])
    found = near.join(carried, same, "left")
    before = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prior"))
    return found.select("_row.*", ((F.col("_row.started_at") - before) / float(DAY_MS)).alias("gap_days"), (F.col("_later") | F.coalesce("_next", F.lit(False))).alias("dense_after")).withColumn("asks", text.rlike(f"(?i){probe}"))


def classify(sessions: DataFrame, now: int, probe: str = PROBE) -> DataFrame:
    """One row a project: sessions, probes, last activity (of the session that started last), days since, classification."""
    return _classified(annotate(sessions, probe), now)


def _classified(df: DataFrame, now: int) -> DataFrame:
    probes = F.col("asks") & (F.col("gap_days") >= GAP_DAYS) & ~F.col("dense_after")
    recent = F.max(F.when(F.col("started_at") >= F.lit(now - SILENT_DAYS * DAY_MS), F.col("dense_after").cast("int")))
    out = df.groupBy("project").agg(F.count("*").alias("sessions"), F.count_if(probes).alias("probes"), F.max_by("updated_at", F.struct("started_at", "pos")).alias("last_active_at"), recent.alias("_dense"), F.min("pos").alias("first_pos"))
    out = out.withColumn("days_since_last", F.floor((F.lit(now) - F.col("last_active_at")) / float(DAY_MS)).cast("long"))
    silent = (F.col("days_since_last") >= SILENT_DAYS) & (F.coalesce("_dense", F.lit(0)) == 0)
    kind = F.when(F.col("days_since_last") < ACTIVE_DAYS, "active").when(F.col("probes") > 0, "zombie").when(silent, "zombie").otherwise("dormant")
    return out.withColumn("classification", kind).drop("_dense")


def project_records(sessions: DataFrame, now: int, probe: str = PROBE) -> DataFrame:
    """What classify() gives for sessions with ``project`` (the inferred id), ``display_name`` and ``inference_source``, and besides: the name of the first-seen session, the most specific source (field, then folder, then keyword), first activity, the ids of probing sessions and the bursts."""
    df = written(annotate(sessions, probe))
    rank = F.when(F.col("inference_source") == "project_field", 2).when(F.col("inference_source") == "cwd_basename", 1).otherwise(0)
    asked = F.col("asks") & (F.col("gap_days") >= GAP_DAYS) & ~F.col("dense_after")
    more = df.groupBy("project").agg(
        F.min_by("display_name", "pos").alias("display_name"), F.max_by("inference_source", rank).alias("inference_source"), F.min("started_at").alias("first_active_at"),
        F.transform(F.array_sort(F.collect_list(F.when(asked, F.struct("started_at", "pos", "id")))), lambda s: s["id"]).alias("probe_ids"),
    )
    windows = bursts(sessions).groupBy("project").agg(F.array_sort(F.collect_list(F.struct("start", "end", "n"))).alias("burst_windows"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,n:bigint>>")
    return _classified(df, now).join(more, "project").join(windows, "project", "left").withColumn("burst_windows", F.coalesce("burst_windows", none))


def displayed(lifecycle: DataFrame, every: bool = False) -> DataFrame:
    """Zombies only, unless all are asked for."""
    return lifecycle if every else lifecycle.where("classification = 'zombie'")


def ordered(lifecycle: DataFrame) -> DataFrame:
    rank = F.when(F.col("classification") == "zombie", 0).when(F.col("classification") == "dormant", 1).otherwise(2)
    return lifecycle.orderBy(rank, F.desc("sessions"), "first_pos")


def class_counts(lifecycle: DataFrame) -> DataFrame:
    """All three classes, also those without projects."""
    names = lifecycle.sparkSession.createDataFrame([("active",), ("dormant",), ("zombie",)], "classification string")
    return names.join(lifecycle.groupBy("classification").agg(F.count("*").alias("projects")), "classification", "left").select("classification", F.coalesce("projects", F.lit(0)).cast("long").alias("projects"))


#: Starts of bursts a project that are chosen from within one row; projects with more are chosen from by rounds.
MOST_FOLDED = 2_000


def bursts(sessions: DataFrame) -> DataFrame:
    """Greedy, earliest, disjoint fortnights with three sessions or more: project, start, end (last member's start), n.

    A fortnight that starts at a session is a candidate if it holds enough. Of a project with up to MOST_FOLDED
    candidates the greedy choice is a fold over them; of larger ones it is by pointers: each candidate points to the
    first one after its fortnight, and pointers are doubled until the path from the first candidate is marked.
    """
    narrow = sessions.select("project", "started_at", "pos")
    n = F.col("_within") - F.col("_before")
    # of equal starts the first counts most, and none of them is left when it is taken
    placed = _placed(narrow).where((F.col("_before") == F.col("_earlier")) & (n >= DENSE))
    candidates = written(placed.select("project", "_seg", F.col("started_at").alias("start"), F.col("_end").alias("end"), n.alias("n")))
    large = written(candidates.groupBy("project").agg(F.count("*").alias("_k")).where(F.col("_k") > MOST_FOLDED).select(F.col("project").alias("_p")))
    if large.isEmpty():
        return _folded(candidates)
    of_large = candidates["project"].eqNullSafe(large["_p"])
    return _folded(candidates.join(large, of_large, "left_anti")).unionByName(_jumped(candidates.join(large, of_large, "left_semi")))


def _folded(candidates: DataFrame) -> DataFrame:
    """The greedy choice within one row a project."""
    listed = candidates.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("start", "end", "n"))).alias("c"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,n:bigint>>")
    taken = F.aggregate(
        "c", F.struct(F.lit(None).cast("long").alias("upto"), none.alias("out")),
        lambda acc, x: F.when(acc["upto"].isNull() | (x["start"] > acc["upto"]), F.struct((x["start"] + _SPAN).alias("upto"), F.concat(acc["out"], F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["n"].alias("n")))).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )
    return listed.select("project", F.explode(taken).alias("b")).select("project", "b.*")


def _jumped(candidates: DataFrame) -> DataFrame:
    """The same by pointers; windows are over one fortnight's candidates or one row a fortnight."""
    candidates = written(candidates)
    along = Window.partitionBy("project").orderBy("_seg")
    segments = candidates.groupBy("project", "_seg").agg(F.min("start").alias("first"))
    nexts = segments.select("project", "_seg", F.lead("_seg").over(along).alias("_s1"), F.lead("first").over(along).alias("_f1"), F.lead("first", 2).over(along).alias("_f2"))
    # within the next fortnight: the first candidate after the end of this one's
    asked = candidates.select("project", (F.col("_seg") + 1).alias("_seg"), (F.col("start") + _SPAN).alias("x"), F.col("start").alias("asks"), F.lit(None).cast("long").alias("c"))
    both = asked.unionByName(candidates.select("project", "_seg", F.col("start").alias("x"), F.lit(None).cast("long").alias("asks"), F.col("start").alias("c")))
    later = Window.partitionBy("project", "_seg").orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, -1)
    within = both.withColumn("near", F.min("c").over(later)).where("asks IS NOT NULL").select("project", (F.col("_seg") - 1).alias("_seg"), F.col("asks").alias("start"), "near")
    pointed = within.alias("w").hint("merge").join(nexts.alias("n"), F.expr("w.project <=> n.project AND w._seg = n._seg")).select("w.project", "w.start", F.when(F.expr("n._s1 = w._seg + 1"), F.expr("coalesce(w.near, n._f2)")).otherwise(F.col("n._f1")).alias("to"))
    jumps = written(pointed.where("to IS NOT NULL"))
    marks = written(candidates.groupBy("project").agg(F.min("start").alias("start")))
    # merged, not broadcast: tables of a round are small enough for that one by one, but their sum goes through the driver
    while True:
        step = F.expr("a.project <=> b.project AND a.start = b.start")
        new = written(marks.alias("a").hint("merge").join(jumps.alias("b"), step).select("a.project", F.col("b.to").alias("start")))
        if new.isEmpty():
            break
        marks = written(marks.unionByName(new))
        jumps = written(jumps.alias("a").hint("merge").join(jumps.alias("b"), F.expr("a.project <=> b.project AND a.to = b.start")).select("a.project", "a.start", "b.to"))
    return candidates.alias("a").hint("merge").join(marks.alias("b"), F.expr("a.project <=> b.project AND a.start = b.start"), "left_semi").select("project", "start", "end", "n")


def zombie_sessions(sessions: DataFrame, lifecycle: DataFrame) -> DataFrame:
    return sessions.join(lifecycle.where("classification = 'zombie'").select("project"), "project", "left_semi")
