"""Exact duplicate clusters, and clusters of several tiers merged over shared sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LEAST_HASHED, content_hash, normalize_for_hash
from .graph import components, written


def hashes(sessions: DataFrame, text: str = "first_human_text", id_col: str = "id", pos: str = "pos", min_length: int = LEAST_HASHED) -> DataFrame:
    """(id, pos, hash, sample_text) of the texts that count, written: a text is normalised once, and only its hash is joined and grouped."""
    normal = sessions.select(F.col(id_col).alias("id"), F.col(pos).alias("pos"), normalize_for_hash(F.col(text)).alias("norm"))
    return written(normal.select("id", "pos", F.char_length("norm").alias("n"), content_hash(F.col("norm")).alias("hash"), F.left("norm", F.lit(200)).alias("sample_text"))).where((F.col("sample_text") != "") & (F.col("n") >= min_length)).drop("n")


def exact_clusters(sessions: DataFrame, text: str = "first_human_text", id_col: str = "id", pos: str = "pos", min_length: int = LEAST_HASHED) -> DataFrame:
    """hash, cluster id, size, session_ids in input order, sample_text; clusters of two or more."""
    hashed = hashes(sessions, text, id_col, pos, min_length)
    # member lists are the result itself; sizes come first, so single texts never reach the lists
    sizes = hashed.groupBy("hash").agg(F.count("*").alias("size"), F.min_by("sample_text", "pos").alias("sample_text")).where("size >= 2")
    members = hashed.select("hash", "id", "pos").join(sizes, "hash")
    grouped = members.groupBy("hash").agg(F.first("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("session_ids"), F.first("sample_text").alias("sample_text"))
    return grouped.withColumn("cluster_id", F.left("hash", F.lit(12)))


def ordered(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(F.desc("size"), "hash")


def session_index(clusters: DataFrame, order: str = "pos") -> DataFrame:
    """(session_id, cluster_id): the first cluster of each session."""
    rows = clusters.select("cluster_id", F.col(order).alias("_o"), F.explode("session_ids").alias("session_id"))
    return rows.groupBy("session_id").agg(F.min_by("cluster_id", F.struct("_o", "cluster_id")).alias("cluster_id"))


def cluster_members(clusters: DataFrame, sessions: DataFrame, columns: list[str]) -> DataFrame:
    """(cluster_id, at, session columns) of the members that exist, in the clusters' order."""
    rows = clusters.select("cluster_id", F.posexplode("session_ids").alias("at", "id"))
    return rows.join(sessions.select("id", *[c for c in columns if c != "id"]), "id").select("cluster_id", "at", *dict.fromkeys(["id", *columns]))


def largest_labels(labelled: DataFrame, n: int) -> DataFrame:
    """The n most frequent emergent ('~') labels of cloud sessions: label, size. Equal sizes: by label."""
    emergent = labelled.where((F.col("source") == "cloud") & F.col("label").startswith("~"))
    return emergent.groupBy("label").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "label").limit(n)


def parse_clusters(files: DataFrame, text: str = "value") -> DataFrame:
    """Rows (id, hash, session_ids, sample_text) of cluster files (one JSON text a row). A file that is no object with a list of clusters gives none, a cluster without id, hash, sessionIds or sampleText of the right type is left out, and ids that are no strings are dropped."""
    of = lambda v, path: F.try_variant_get(v, path, "variant")
    word = lambda v, path: F.when(F.schema_of_variant(of(v, path)) == "STRING", F.try_variant_get(v, path, "string"))
    listed = lambda v, path: F.when(F.schema_of_variant(of(v, path)).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))
    rows = files.select(F.try_parse_json(text).alias("v")).select(F.explode(listed("v", "$.clusters")).alias("c"))
    ids = F.filter(F.transform(listed("c", "$.sessionIds"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda s: s.isNotNull())
    found = rows.select(word("c", "$.id").alias("id"), word("c", "$.hash").alias("hash"), ids.alias("session_ids"), word("c", "$.sampleText").alias("sample_text"))
    return found.where("id IS NOT NULL AND hash IS NOT NULL AND session_ids IS NOT NULL AND sample_text IS NOT NULL")


def merged_clusters(exact: DataFrame, semantic: DataFrame) -> DataFrame:
    """Clusters of both tiers that share sessions become one: kind, representative (first seen), session_ids.

    ``exact`` and ``semantic`` have cluster_id, pos and session_ids. If one tier is empty the other passes
    through as it is: clusters of one tier alone are never merged.
    """
    tag = lambda df, kind, t: df.select(F.struct(F.lit(t).alias("tier"), F.col("pos"), F.col("cluster_id")).alias("node"), F.lit(kind).alias("kind"), "session_ids")
    nodes = tag(exact, "exact", 0).unionByName(tag(semantic, "semantic", 1)).withColumn("v", F.xxhash64("node"))
    members = nodes.select("v", "node", "kind", F.posexplode("session_ids").alias("at", "session_id"))
    if exact.isEmpty() or semantic.isEmpty():
        labelled = members.withColumn("root", F.col("v"))
    else:
        # a star around each session's least cluster connects what it shares, one edge a membership
        least = members.groupBy("session_id").agg(F.min("v").alias("a"))
        edges = members.join(least, "session_id").select("a", F.col("v").alias("b")).where("a <> b")
        labelled = members.join(components(edges).withColumnRenamed("root", "_root"), "v", "left").withColumn("root", F.coalesce("_root", "v")).drop("_root")
    firsts = labelled.groupBy("root", "session_id").agg(F.min(F.struct("node", "at")).alias("seen"))
    kinds = labelled.groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kind"), F.min("node")["cluster_id"].alias("representative"))
    sessions = firsts.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "session_id"))), lambda s: s["session_id"]).alias("session_ids"))
    return kinds.join(sessions, "root").drop("root")
