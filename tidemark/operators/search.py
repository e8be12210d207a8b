"""Search, facets, sort orders and neighbours over the session table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cost import effective_cost
from .graph import written


def matches(query: str, columns=("title", "summary", "preview", "cwd", "project"), tools: str | None = "top_tools", models: str | None = "models_used") -> Column:
    """The trimmed, lower-cased query is a literal part of a text column, a tool's name or a used model. An empty query matches all."""
    q = query.strip().lower()
    if not q:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    for c in ([F.map_keys(tools)] if tools else []) + ([F.col(models)] if models else []):
        hit = hit | F.coalesce(F.exists(c, lambda x: F.contains(F.lower(x), F.lit(q))), F.lit(False))
    return hit


def filter_sessions(sessions: DataFrame, query: str = "", sources=(), hide_empty: bool = True, projects=(), unknown_project: bool = False, topics=(), tool: str | None = None, **search) -> DataFrame:
    """Only the predicates that are asked for enter the plan; simple ones reach the scan."""
    df = sessions
    if sources:
        df = df.where(F.col("source").isin(*sources))
    if hide_empty:
        df = df.where(F.col("user_turns") > 0)
    if projects or unknown_project:
        none = F.coalesce("project", F.lit("")) == ""
        df = df.where((F.col("project").isin(*projects) if projects else F.lit(False)) | (none if unknown_project else F.lit(False)))
    if topics:
        df = df.where(F.col("topic").isin(*topics))
    if tool:
        df = df.where(F.map_contains_key("top_tools", F.lit(tool)))
    return df.where(matches(query, **search)) if query.strip() else df


def sort_order(axis: str) -> list[Column]:
    """recent and oldest tie by position alone; the others by the latest update first. Sessions without a project come first, as '~~' sorts before letters."""
    latest = F.desc("updated_at")
    return {
        "recent": [latest, F.col("pos")], "oldest": [F.col("updated_at"), F.col("pos")], "cost": [F.coalesce(effective_cost(), F.lit(0.0)).desc(), latest, F.col("pos")],
        "turns": [F.desc("user_turns"), latest, F.col("pos")], "project": [F.collate(F.coalesce("project", F.lit("~~")), "UNICODE"), latest, F.col("pos")],
    }[axis]


def page(sessions: DataFrame, axis: str = "recent", size: int = 50) -> DataFrame:
    """The first page; a top-k, not a sort of everything."""
    return sessions.orderBy(*sort_order(axis)).limit(size)


def ranked(sessions: DataFrame, axis: str = "recent") -> DataFrame:
    """(id, rank, part, at) of every session in the order of ``axis``: range partitions, each sorted by its own task, and the sums of their counts as offsets.

    Positions end every order, so equal sort keys don't make a large partition.
    """
    order = sort_order(axis)
    row = F.monotonically_increasing_id()
    placed = written(sessions.repartitionByRange(*order).sortWithinPartitions(*order).select("id", F.shiftright(row, ROW_BITS).alias("part"), row.bitwiseAND((1 << ROW_BITS) - 1).alias("at")))
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())  # one row a partition
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    table = sessions.sparkSession.createDataFrame(offsets, "part long, before long")
    return placed.join(F.broadcast(table), "part").select("id", (F.col("before") + F.col("at") + 1).alias("rank"), "part", "at")


#: Bits of a row's number within its partition (monotonically_increasing_id); the partition's number is above.
ROW_BITS = 33


def nth_page(sessions: DataFrame, axis: str = "recent", number: int = 1, size: int = 50) -> DataFrame:
    """(id, rank) of any page of the list, 1 for the first."""
    return ranked(sessions, axis).where(F.col("rank").between((number - 1) * size + 1, number * size)).select("id", "rank")


def ranked_page(sessions: DataFrame, axis: str, size: int = 50) -> DataFrame:
    """The first page with its ranks; a top-k, so nothing but `size` rows is ordered."""
    return page(sessions, axis, size).withColumn("rank", F.row_number().over(Window.orderBy(*sort_order(axis))))


def neighbours(sessions: DataFrame, axis: str = "recent") -> DataFrame:
    """(id, rank, previous_id, next_id) of every session of the list, null at its ends.

    Neighbours are those within a partition of ranked(); a partition's first and last row get theirs from the partitions
    beside it, of which the driver knows the ends (two ids a partition).
    """
    rows = ranked(sessions, axis)
    ends = sorted(rows.groupBy("part").agg(F.min_by("id", "at").alias("first"), F.max_by("id", "at").alias("last")).collect(), key=lambda r: r["part"])
    kind = sessions.schema["id"].dataType.simpleString()
    beside = [(r["part"], ends[k - 1]["last"] if k else None, ends[k + 1]["first"] if k + 1 < len(ends) else None) for k, r in enumerate(ends)]
    table = sessions.sparkSession.createDataFrame(beside, f"part long, before {kind}, after {kind}")
    order = Window.partitionBy("part").orderBy("at")
    near = rows.select("id", "rank", "part", F.lag("id").over(order).alias("p"), F.lead("id").over(order).alias("n"), F.lag("at").over(order).isNull().alias("starts"), F.lead("at").over(order).isNull().alias("ends"))
    pick = lambda edge, other, own: F.when(F.col(edge), F.col(other)).otherwise(F.col(own))
    return near.join(F.broadcast(table), "part").select("id", "rank", pick("starts", "before", "p").alias("previous_id"), pick("ends", "after", "n").alias("next_id"))


def top_tools(tools: Column, n: int = 3) -> Column:
    """'name n' of the most used tools, by count, then name."""
    entries = F.array_sort(F.transform(F.map_entries(tools), lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("name"), e["value"].alias("n"))))
    return F.array_join(F.transform(F.slice(entries, 1, n), lambda e: F.concat(e["name"], F.lit(" "), e["n"].cast("string"))), ", ")


def all_cloud(sessions: DataFrame) -> DataFrame:
    return sessions.agg((F.coalesce(F.bool_and(F.col("source") == "cloud"), F.lit(False)) & (F.count("*") > 0)).alias("all_cloud"))
