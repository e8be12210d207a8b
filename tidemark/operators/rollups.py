"""Counts by source, week, month and facet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import timestamp, week_start
from ..schema import DAY_MS, SOURCES

WEEK_MS = 7 * DAY_MS


def source_counts(sessions: DataFrame) -> DataFrame:
    """All four sources, also those without sessions."""
    names = sessions.sparkSession.createDataFrame([(s,) for s in SOURCES], "source string")
    return names.join(sessions.groupBy("source").agg(F.count("*").alias("n")), "source", "left").select("source", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _weeks(counts: DataFrame) -> DataFrame:
    """All weeks between the first and the last that occur (two numbers decide; no scan of the sessions)."""
    return counts.agg(F.min("week").alias("lo"), F.max("week").alias("hi")).where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi", F.lit(WEEK_MS))).alias("week"))


def weekly(sessions: DataFrame, at: str = "updated_at") -> DataFrame:
    """(week, n): Sunday weeks in UTC, dense."""
    counts = sessions.groupBy(week_start(F.col(at)).alias("week")).agg(F.count("*").alias("n"))
    return _weeks(counts).join(counts, "week", "left").select("week", F.coalesce("n", F.lit(0)).alias("n"))


def weekly_by_source(sessions: DataFrame, at: str = "updated_at", sources=SOURCES) -> DataFrame:
    """Dense weeks with a column for each source."""
    counts = sessions.groupBy(week_start(F.col(at)).alias("week")).agg(*[F.count_if(F.col("source") == s).alias(s.replace("-", "_")) for s in sources])
    names = [s.replace("-", "_") for s in sources]
    return _weeks(counts).join(counts, "week", "left").select("week", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def visible_weeks(everything: DataFrame, visible: DataFrame, at: str = "updated_at") -> DataFrame:
    """Weeks of the whole corpus with how many of its sessions are visible now."""
    seen = visible.groupBy(week_start(F.col(at)).alias("week")).agg(F.count("*").alias("visible"))
    return weekly(everything, at).join(seen, "week", "left").select("week", F.col("n").alias("total"), F.coalesce("visible", F.lit(0)).alias("visible"))


def timeline_stats(weeks: DataFrame) -> DataFrame:
    """One row over (week, total, visible): sums, the first week of the highest total, mean a week."""
    return weeks.agg(
        F.sum("total").alias("total"), F.sum("visible").alias("visible"), F.max("total").alias("peak"), F.min_by("week", F.struct(-F.col("total"), F.col("week"))).alias("peak_week"),
        F.count("*").alias("weeks"), (F.sum("total") / F.count("*")).alias("per_week"),
    )


def month_ticks(weeks: DataFrame) -> DataFrame:
    """Weeks at which a month begins: month, and the year where that changes too."""
    order = Window.orderBy("week")  # one short row a week
    df = weeks.select("week", F.month(timestamp(F.col("week"))).alias("month"), F.year(timestamp(F.col("week"))).alias("year"))
    df = df.withColumn("pm", F.lag("month").over(order)).withColumn("py", F.lag("year").over(order))
    new_year = F.col("py").isNull() | (F.col("py") != F.col("year"))
    return df.where(new_year | (F.col("pm") != F.col("month"))).select("week", "month", F.when(new_year, F.col("year")).alias("year"))


def facet_counts(sessions: DataFrame) -> DataFrame:
    """(facet, value, n): projects partition the rows, with one row for those without; topics count apart."""
    project = F.when(F.coalesce("project", F.lit("")) != "", F.col("project")).otherwise("(unknown)")
    pairs = F.array(F.struct(F.lit("project").alias("facet"), project.alias("value")), F.struct(F.lit("topic").alias("facet"), F.col("topic").alias("value")))
    return sessions.select(F.explode(pairs).alias("p")).where("p.value IS NOT NULL").groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def capped_facets(facets: DataFrame, cap: int, pinned: list[str] = ()) -> DataFrame:
    """Pinned values and the most frequent ones up to ``cap`` of each facet, then one row for the rest."""
    pin = F.col("value").isin(*pinned) if pinned else F.lit(False)
    ranked = facets.withColumn("pinned", pin).withColumn("rank", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("pinned"), F.desc("n"), "value")))
    shown = F.col("pinned") | (F.col("rank") <= cap)
    return ranked.groupBy("facet", F.when(shown, F.col("value")).otherwise("(rest)").alias("value")).agg(F.sum("n").alias("n"), F.count("*").alias("values"))


def date_range(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.min("started_at").alias("first_at"), F.max("updated_at").alias("last_at"))


def timeline_positions(sessions: DataFrame, at: str = "started_at") -> DataFrame:
    """Place of each session on the time axis, 0 to 100. The bounds are one row from an aggregate, not a window over all rows."""
    bounds = sessions.agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    x = (F.col(at) - F.col("_lo")) / F.greatest(F.lit(1), F.col("_hi") - F.col("_lo")) * 100.0
    return sessions.crossJoin(F.broadcast(bounds)).withColumn("x", x).drop("_lo", "_hi")


def semantic_tallies(sessions: DataFrame) -> DataFrame:
    """Distinct emergent topics, labelled sessions, distinct projects, and the shares of cloud sessions labelled either way."""
    cloud = F.col("source") == "cloud"
    named = F.coalesce("project", F.lit("")) != ""
    share = lambda c: F.count_if(cloud & c) / F.greatest(F.count_if(cloud), F.lit(1))
    topic = F.col("topic").isNotNull()
    return sessions.agg(
        F.countDistinct("topic").alias("topics"), F.count_if(topic | named).alias("labelled"), F.countDistinct(F.when(named, F.col("project"))).alias("projects"),
        share(named).alias("classified"), share(~named & topic).alias("emergent"), share(~named & ~topic).alias("unlabelled"),
    )
