"""Session-like views over star-schema tables, each as a DataFrame and as DuckDB text.

Text that both engines read alike is written once (``{ms}`` stands for milliseconds of a timestamp).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import cost
from ..operators.graph import written
from ..schema import DEFAULT_MODEL, RATES, STOPWORDS

#: The day after the last order, for everything that depends on now.
NOW = 996_710_400_000  # 2001-08-02

_SESSIONS = """
SELECT o_orderkey AS id, o_orderkey AS pos, o_custkey,
       CASE o_orderkey % 4 WHEN 0 THEN 'cloud' WHEN 1 THEN 'cowork' WHEN 2 THEN 'cli-direct' ELSE 'cli-desktop' END AS source,
       CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 10 = 1 THEN '' ELSE concat('project-', o_custkey % 40) END AS project,
       CASE WHEN o_orderkey % 11 = 0 THEN concat('~topic-', o_custkey % 5) END AS topic,
       CASE WHEN o_orderpriority = '1-URGENT' THEN concat('Revisit order ', o_orderkey) ELSE concat(o_orderpriority, ' order ', o_orderkey) END AS title,
       concat('status ', o_orderstatus) AS preview, o_orderkey % 5 AS user_turns, o_orderstatus, o_totalprice,
       {ms} AS started_at, {ms} + 7200000 AS updated_at
FROM {orders}
"""
SESSIONS = _SESSIONS.format(ms="epoch_ms(o_orderdate)", orders="orders")

_MODEL = "CASE l_suppkey % 9 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(RATES)) + " WHEN 7 THEN 'unlisted-model' END"
_ORDER = "(l_linenumber, l_partkey, l_suppkey)"
TOKENS = f"""
SELECT l_orderkey AS id, sum(CAST(l_quantity AS BIGINT) * 100)::BIGINT AS input, sum(CAST(floor(l_extendedprice) AS BIGINT))::BIGINT AS output,
       sum(CAST(l_partkey AS BIGINT))::BIGINT AS cache_creation, sum(CAST(l_suppkey AS BIGINT) * 1000)::BIGINT AS cache_read,
       arg_max(m, {_ORDER}) FILTER (WHERE m IS NOT NULL) AS model
FROM (SELECT *, {_MODEL} AS m FROM lineitem) GROUP BY 1
"""
USED = f"""
SELECT id, m, row_number() OVER (PARTITION BY id ORDER BY p) AS ord FROM (
  SELECT l_orderkey AS id, m, min({_ORDER}) AS p FROM (SELECT *, {_MODEL} AS m FROM lineitem) WHERE m IS NOT NULL GROUP BY 1, 2)
"""
_RATES = "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {', '.join(f'{x}::DOUBLE' for x in r)})" for m, r in RATES.items()) + ") AS r(rm, r_in, r_out, r_new, r_read)"
#: sessions with tokens and prices: CTEs s, t, used, rates, picked, priced
PRICED = f"""
s AS ({SESSIONS}), t AS ({TOKENS}), used AS ({USED}), rates AS ({_RATES}), n_used AS (SELECT id, count(*) AS n, arg_min(m, ord) AS first_m FROM used GROUP BY 1),
dear AS (SELECT id, m FROM (SELECT u.id, u.m, row_number() OVER (PARTITION BY u.id ORDER BY r_out DESC, (u.m = t.model) DESC, ord) AS k FROM used u JOIN rates ON rm = u.m JOIN t ON t.id = u.id) WHERE k = 1),
picked AS (
  SELECT t.id, t.model, t.input, t.output, t.cache_creation, t.cache_read,
         CASE WHEN n = 1 THEN first_m WHEN n > 1 THEN coalesce(d.m, first_m) ELSE coalesce(t.model, '{DEFAULT_MODEL}') END AS pick,
         CASE WHEN n > 1 AND d.m IS NOT NULL THEN 'cost-weighted model selection' WHEN n IS NULL AND t.model IS NULL THEN 'assumed_model' END AS note
  FROM t LEFT JOIN n_used USING (id) LEFT JOIN dear d ON d.id = t.id),
priced AS (
  SELECT s.*, p.model, p.input, p.output, p.pick, p.note, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1000 END AS total_cost_usd,
         p.input * r_in / 1000000 AS input_usd, p.output * r_out / 1000000 AS output_usd, p.cache_creation * r_new / 1000000 AS cache_write_usd, p.cache_read * r_read / 1000000 AS cache_read_usd,
         CASE WHEN o_orderstatus <> 'F' AND p.id IS NOT NULL AND rm IS NULL THEN p.pick END AS unknown_model,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1000 ELSE p.input * r_in / 1000000 + p.output * r_out / 1000000 + p.cache_creation * r_new / 1000000 + p.cache_read * r_read / 1000000 END AS cost
  FROM s LEFT JOIN picked p USING (id) LEFT JOIN rates ON rm = p.pick)
"""
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
WORDS = f"SELECT doc_id AS doc, source, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z]{{2,}}')), lambda w: w NOT IN ({_STOP})) AS tokens FROM documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SESSIONS.format(ms="unix_millis(CAST(o_orderdate AS TIMESTAMP))", orders="{orders}"), orders=table(spark, sf_dir, "orders"))


def token_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sums and models of each order's lines, in one hash aggregate: all its values are numbers.

    A line's place is one number (line, part and supplier, 3, 34 and 26 bits), from which its model follows; the first
    place of each model gives the order of models.
    """
    lines = table(spark, sf_dir, "lineitem").withColumn("o", F.shiftleft(F.col("l_linenumber").cast("long"), 60) + F.shiftleft("l_partkey", 26) + F.col("l_suppkey")).withColumn("r", F.col("l_suppkey") % 9)
    total = lambda e: F.sum(F.expr(e)).cast("long")
    models = [*RATES, "unlisted-model"]
    name = F.element_at(F.array(*map(F.lit, models)), ((F.col("last").bitwiseAND(F.lit((1 << 26) - 1))) % 9 + 1).cast("int"))
    sums = lines.groupBy(F.col("l_orderkey").alias("id")).agg(
        total("CAST(l_quantity AS BIGINT) * 100").alias("input"), total("CAST(floor(l_extendedprice) AS BIGINT)").alias("output"), total("CAST(l_partkey AS BIGINT)").alias("cache_creation"), total("CAST(l_suppkey AS BIGINT) * 1000").alias("cache_read"),
        F.max(F.when(F.col("r") < len(models), F.col("o"))).alias("last"), *[F.min(F.when(F.col("r") == i, F.col("o"))).alias(f"m{i}") for i in range(len(models))],
    )
    firsts = F.array(*[F.when(F.col(f"m{i}").isNotNull(), F.struct(F.col(f"m{i}").alias("o"), F.lit(m).alias("m"))) for i, m in enumerate(models)])
    used = F.transform(F.array_sort(F.filter(firsts, lambda s: s.isNotNull())), lambda s: s["m"])
    return sums.select("id", F.struct("input", "output", "cache_creation", "cache_read").alias("token_totals"), F.when(F.col("last").isNotNull(), name).alias("model"), used.alias("models_used"))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sessions(spark, sf_dir).join(token_sessions(spark, sf_dir), "id", "left").withColumn("total_cost_usd", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 1000))
    return cost.price(df)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sender = F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), sender.alias("sender"), "text")


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("tool")).agg(F.count("*").alias("n"), F.min("event_id").alias("pos"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, source, tokens), written: texts are cut to words once, also where one query explodes them (Spark asks for an exploded list's size before, which would cut each text again)."""
    return written(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source", tokens(F.col("text")).alias("tokens")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label."""
    means = vectors(spark, sf_dir).select("label", F.posexplode("vec").alias("at", "x")).groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("vec")).select(F.concat(F.lit("p"), F.col("label").cast("string")).alias("centroid_id"), F.col("label").alias("ord"), "vec")


CENTROIDS = """
SELECT concat('p', label) AS centroid_id, label AS ord, list(m ORDER BY i) AS vec FROM (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, 65)) AS u(i) GROUP BY 1, 2) GROUP BY 1, 2
"""
