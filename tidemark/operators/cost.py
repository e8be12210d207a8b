"""Token cost: model choice, estimates and the cost tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_key, month_label, timestamp
from ..schema import DEFAULT_MODEL, RATES
from .graph import written


def _rate(rates: dict, at: int, model: Column) -> Column:
    """One rate of a model, null if it isn't known: one comparison for each distinct rate, in the scan stage instead of a join (the table has a few rows and is fixed)."""
    levels: dict[float, list[str]] = {}
    for name, r in rates.items():
        levels.setdefault(r[at], []).append(name)
    out = F.lit(None).cast("double")
    for rate, names in levels.items():
        out = F.when(model.isin(*names), F.lit(rate)).otherwise(out)
    return out


def pick_model(model: Column, used: Column, rates: dict = RATES) -> tuple[Column, Column]:
    """(model to price on, note). Of several used models the one with the dearest output; of equals the session's own model, then the first."""
    levels: dict[float, list[str]] = {}
    for name, r in rates.items():
        levels.setdefault(r[1], []).append(name)
    best = F.lit(None).cast("string")
    for rate in sorted(levels):  # the dearest is asked for first
        names = F.array(*[F.lit(x) for x in levels[rate]])
        own = F.when(model.isin(*levels[rate]) & F.array_contains(used, model), model)
        best = F.when(F.arrays_overlap(used, names), F.coalesce(own, F.get(F.array_intersect(used, names), F.lit(0)))).otherwise(best)
    n = F.coalesce(F.size(used), F.lit(0))
    best = F.when(n > 1, best)
    chosen = F.when(n > 1, F.coalesce(best, F.get(used, F.lit(0)))).when(n == 1, F.get(used, F.lit(0))).otherwise(F.coalesce(model, F.lit(DEFAULT_MODEL)))
    note = F.when((n > 1) & best.isNotNull(), F.lit("cost-weighted model selection")).when((n <= 0) & model.isNull(), F.lit("assumed_model"))
    return chosen, note


def price(sessions: DataFrame, rates: dict = RATES) -> DataFrame:
    """Adds cost_estimated_usd, cost_is_estimate, cost_breakdown and unknown_model. An exact cost wins; without tokens or a known rate there is no estimate."""
    t, own = F.col("token_totals"), list(sessions.columns)
    chosen, note = pick_model(F.col("model"), F.col("models_used"), rates)
    m, exact, fields = F.col("_m"), F.col("total_cost_usd"), ("input", "output", "cache_creation", "cache_read")
    df = sessions.withColumns({"_m": chosen, "_note": note})
    df = df.withColumns({f"_r{i}": _rate(rates, i, m) for i in range(4)})
    df = df.withColumns({f"_p{i}": t[f] * F.col(f"_r{i}") / 1_000_000 for i, f in enumerate(fields)} | {"_known": F.col("_r0").isNotNull()})
    total = F.col("_p0") + F.col("_p1") + F.col("_p2") + F.col("_p3")
    estimated = exact.isNull() & t.isNotNull() & F.col("_known")
    names = ("input_usd", "output_usd", "cache_write_usd", "cache_read_usd")
    return df.select(
        *own, F.when(exact.isNotNull(), exact).when(estimated, total).alias("cost_estimated_usd"), estimated.alias("cost_is_estimate"),
        F.when(estimated, F.struct(m.alias("model_id_used"), *[F.col(f"_p{i}").alias(n) for i, n in enumerate(names)], F.col("_note").alias("note"))).alias("cost_breakdown"),
        F.when(exact.isNull() & t.isNotNull() & ~F.col("_known"), m).alias("unknown_model"),
    )


def effective_cost() -> Column:
    return F.coalesce("total_cost_usd", "cost_estimated_usd")


def _usd(c: Column) -> Column:
    """A sum in exact decimals of 1e-8 USD: the same whatever the order of the rows."""
    return F.coalesce(F.sum(c.cast("decimal(18,8)")).cast("double"), F.lit(0.0))


def _sums() -> list[Column]:
    estimate = F.when(F.col("total_cost_usd").isNull(), F.col("cost_estimated_usd"))
    return [F.count("*").alias("sessions"), _usd(F.col("total_cost_usd")).alias("exact_usd"), _usd(estimate).alias("estimate_usd")]


def by_month(priced: DataFrame) -> DataFrame:
    """Exact and estimated cost of each month (UTC, of updated_at) that has sessions with a cost. Months are numbers until they are few."""
    at = timestamp(F.col("updated_at"))
    # counted, not filtered by cost: a filter on a price is a second pricing of each row
    sums = priced.groupBy((F.year(at) * 12 + F.month(at) - 1).alias("_m")).agg(F.count(effective_cost()).alias("sessions"), *_sums()[1:]).where("sessions > 0")
    start = F.unix_millis(F.make_timestamp(F.floor(F.col("_m") / 12).cast("int"), F.pmod("_m", F.lit(12)) + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return sums.select(month_key(start).alias("month"), month_label(start).alias("label"), "sessions", "exact_usd", "estimate_usd")


def by_model(priced: DataFrame) -> DataFrame:
    """Sessions, cost, output tokens and share of the total cost of each model."""
    sums = priced.groupBy(F.coalesce("model", F.lit("(unknown)")).alias("model")).agg(*_sums(), F.coalesce(F.sum("token_totals.output"), F.lit(0)).alias("output_tokens"))
    total = F.sum(F.col("exact_usd") + F.col("estimate_usd")).over(Window.partitionBy())  # one row a model
    return sums.withColumn("share", F.when(total > 0, (F.col("exact_usd") + F.col("estimate_usd")) / total).otherwise(0.0))


def by_project(priced: DataFrame, top: int = 8) -> DataFrame:
    """The dearest projects and the rest as one row. Only a missing project is untagged; an empty name is a name."""
    sums = written(priced.groupBy(F.coalesce("project", F.lit("__untagged__")).alias("project")).agg(*_sums()))  # one row a project, read twice
    cost = F.col("exact_usd") + F.col("estimate_usd")
    first = sums.orderBy(cost.desc(), "project").limit(top).select("project", "sessions", "exact_usd", "estimate_usd", F.lit(1).alias("n_projects"))
    rest = sums.join(F.broadcast(first.select("project")), "project", "left_anti")  # `top` rows
    folded = rest.agg(F.sum("sessions").alias("sessions"), _usd(F.col("exact_usd")).alias("exact_usd"), _usd(F.col("estimate_usd")).alias("estimate_usd"), F.count("*").cast("int").alias("n_projects"))
    return first.unionByName(folded.where("n_projects > 0").withColumn("project", F.lit("__rest__")))


def unknown_models(priced: DataFrame) -> DataFrame:
    return priced.where(F.col("unknown_model").isNotNull()).groupBy(F.col("unknown_model").alias("model")).agg(F.count("*").alias("sessions"))


def most_expensive(priced: DataFrame, n: int = 20, tool: str | None = None) -> DataFrame:
    df = priced if tool is None else priced.where(F.map_contains_key("top_tools", F.lit(tool)))
    # nulls come last, so they are left out of the few rows instead of all
    return df.withColumn("cost", effective_cost()).orderBy(F.desc_nulls_last("cost"), "id").limit(n).where("cost IS NOT NULL")


def kpis(priced: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """One row: cost sums, output tokens, the most used tool, the project of most sessions, how many are tagged."""
    tagged = F.col("project").isNotNull() & (F.col("project") != "")
    sums = priced.agg(*_sums(), F.coalesce(F.sum("token_totals.output"), F.lit(0)).alias("output_tokens"), F.count_if(tagged).alias("tagged"))
    best = lambda df, key, n: df.agg(F.max_by(F.col(key), F.struct(F.col(n), F.col("_tie"))).alias(key))
    projects = priced.where(tagged).groupBy("project").agg(F.count("*").alias("n"), (-F.min("pos")).alias("_tie"))
    out = sums.crossJoin(best(projects, "project", "n").withColumnRenamed("project", "top_project"))  # one row each
    if tools is not None:
        counts = tools.groupBy("tool").agg(F.sum("n").alias("n"), (-F.min("pos")).alias("_tie"))
        out = out.crossJoin(best(counts, "tool", "n").withColumnRenamed("tool", "top_tool"))
    return out
