"""Topic discovery: complete linkage, distinctive terms, rescue of outliers, coherence, k-means."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import cluster_id
from ..functions.text import cut_title
from .graph import components, written
from .similarity import cluster_pairs, dot, mean_pool, nearest

LINK, MIN_SIZE, TERMS, RESCUE, TOP_N, MOST_LINKED = 0.5, 3, 3, 0.30, 10, 5_000
MIN_TOKENS, MIN_INPUTS = 3, 30
#: Pairs a vector that MOST_LINKED vectors may have in one task; rounds after which rest components are looked for.
PAIRS_A_VECTOR, ROUNDS = 400, 12
#: Vectors by which linkage() chooses its levels, pairs a vector at the first level, and by how much more at each next one.
SAMPLED, FIRST_PAIRS, MORE = 2_048, 16, 8


def doc_frequency(tokens: DataFrame) -> DataFrame:
    """(token, df) over (doc, tokens: distinct words)."""
    return tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def inverse_frequency(tokens: DataFrame) -> DataFrame:
    """(token, df, idf), written: ln(N / df) over all documents, also those without tokens."""
    n = tokens.count()
    return written(doc_frequency(tokens).withColumn("idf", F.ln(F.lit(float(n)) / F.col("df"))))


def distinctive_terms(members: DataFrame, tokens: DataFrame, k: int = TERMS) -> DataFrame:
    """(cluster, token, score, rank): tokens by the sum over members (cluster, doc) of ln(N / df). Equal scores: by token (a stated choice: the order of first use depends on how a corpus is cut up). A document is in one cluster at most."""
    return terms_of(tokens.join(members, "doc", "left"), k)


def label_counts(placed: DataFrame, by: str) -> DataFrame:
    """(by, token, n), written: how many documents of ``placed`` (by: null for none, tokens) have a token, by label or cluster. Their sums over all of them are document frequencies."""
    return written(placed.select(by, F.explode("tokens").alias("token")).groupBy(by, "token").agg(F.count("*").alias("n")))


def frequencies(counts: DataFrame, documents: int) -> DataFrame:
    """(token, df, idf) of label_counts()."""
    df = counts.groupBy("token").agg(F.sum("n").alias("df"))
    return df.withColumn("idf", F.ln(F.lit(float(documents)) / F.col("df")))


def terms_of(placed: DataFrame, k: int = TERMS) -> DataFrame:
    """distinctive_terms() of documents ``placed`` (cluster: null for none, tokens): tokens are counted once, and ranks up to k are cut before the shuffle."""
    counts = label_counts(placed, "cluster")
    scored = counts.where("cluster IS NOT NULL").join(frequencies(counts, placed.count()), "token").select("cluster", "token", (F.col("n") * F.col("idf")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("score", 9)), "token"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("cluster", "token", "score", "rank")


def term_labels(terms: DataFrame) -> DataFrame:
    return terms.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("token")), " + ").alias("label"))


def linkage(similarities: np.ndarray, threshold: float) -> list[list[int]]:
    """Complete linkage: merge the pair of clusters with the greatest least similarity while that is ``threshold`` or more; equal: the lowest pair.

    A merged cluster keeps the place of its lower one. The greatest similarity of each row is kept, so a merge
    costs one pass over a row and a few rows anew, not over the matrix.
    """
    s = similarities.astype(np.float32).copy()
    n = len(s)
    np.fill_diagonal(s, -np.inf)
    upper = np.triu(np.ones((n, n), bool), 1)
    s_up = np.where(upper, s, -np.inf)
    best_at = s_up.argmax(axis=1) if n else np.empty(0, int)
    best = s_up[np.arange(n), best_at] if n else np.empty(0)
    members = [[i] for i in range(n)]
    while n > 1:
        i = int(best.argmax())
        if not best[i] >= threshold:
            break
        j = int(best_at[i])
        members[i] += members[j]
        members[j] = []
        row = np.minimum(s[i], s[j])
        row[[i, j]] = -np.inf
        s[i, :] = s[:, i] = row
        s[j, :] = s[:, j] = -np.inf
        s_up[i], s_up[:, j], s_up[j] = np.where(upper[i], row, -np.inf), -np.inf, -np.inf
        s_up[:i, i] = row[:i]
        stale = np.flatnonzero((best_at == i) | (best_at == j))
        for r in {i, j, *stale.tolist()}:
            best_at[r] = s_up[r].argmax()
            best[r] = s_up[r, best_at[r]]
        better = np.flatnonzero((s_up[:i, i] > best[:i]) | ((s_up[:i, i] == best[:i]) & (best_at[:i] > i)))
        best[better], best_at[better] = s_up[better, i], i
    return [m for m in members if m]


def merged(a: np.ndarray, b: np.ndarray, sims: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, clusters) by linkage_rounds() in one task, over pairs a < b of clusters of na and nb vectors."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.split(at.reshape(-1), 2)
    size, cluster = np.ones(len(names), np.int64), np.arange(len(names))
    size[a], size[b] = na, nb
    while len(a):
        rank = np.empty(len(a), np.int64)
        rank[np.lexsort((b, a, -sims))] = np.arange(len(a))
        best = np.full(len(names), len(a))
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        merge = (best[a] == rank) & (best[b] == rank)
        into, grown = np.arange(len(names)), size.copy()
        into[b[merge]] = a[merge]
        grown[a[merge]] += size[b[merge]]
        cluster = into[cluster]
        n = size[a] * size[b]
        a, b = np.sort(np.stack([into[a], into[b]]), axis=0)
        order = np.lexsort((b, a))
        order = order[a[order] != b[order]]
        a, b, sims, n, size = a[order], b[order], sims[order], n[order], grown
        first = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
        if len(first):
            a, b, sims, n = a[first], b[first], np.minimum.reduceat(sims, first), np.add.reduceat(n, first)
        whole = n == size[a] * size[b]
        a, b, sims = a[whole], b[whole], sims[whole]
    return names, names[cluster]


def complete_linkage(vectors: DataFrame, threshold: float = LINK, pos: str = "pos") -> DataFrame:
    """(pos, cluster): the clusters of ``vectors`` (pos, vec), named by their first member.

    Equal vectors are one to begin with. More than MOST_LINKED are clustered at falling levels, the last of which is the
    threshold: merges come in falling order, so those at a level need pairs at it only, and at the next level pairs of
    members are reduced to pairs of clusters where they are multiplied. Any levels give the same clusters; theirs are
    chosen so that a level has few pairs.
    """
    given = vectors.select(F.col(pos).cast("long").alias("pos"), "vec")
    vectors = written(given.groupBy("vec").agg(F.min("pos").alias("pos"), F.collect_list("pos").alias("same")))
    members, levels = vectors.select("pos", F.col("pos").alias("cluster"), "vec"), _levels(vectors, threshold)
    for k, level in enumerate(levels):
        members = written(_linked(members, level, level == threshold, k == 0))
    placed = vectors.join(members.select("pos", "cluster"), "pos").select(F.explode("same").alias("pos"), "cluster")
    return given.select("pos").join(placed, "pos", "left").select("pos", F.coalesce("cluster", "pos").alias("cluster"))


def _levels(vectors: DataFrame, threshold: float) -> list[float]:
    """Falling similarities, the last the threshold. A sample of vectors tells how many pairs there are above each; that is only about time."""
    n = vectors.where("vec IS NOT NULL").count()
    if n <= MOST_LINKED:
        return [threshold]
    x = np.array([r["vec"] for r in vectors.where("vec IS NOT NULL").orderBy(F.xxhash64("pos"), "pos").select("vec").limit(SAMPLED).collect()], np.float64)
    sims = np.sort((x @ x.T)[np.triu_indices(len(x), 1)])[::-1]
    every, found, wanted = int((sims >= threshold).sum()), [], 2 * FIRST_PAIRS / n * len(sims)
    while wanted * 3 < every:
        level = float(np.float32(sims[int(wanted)]))
        if level > threshold and (not found or level < found[-1]):
            found.append(level)
        wanted = max(wanted, 1) * MORE
    return [*found, threshold]


def _linked(members: DataFrame, level: float, last: bool, single: bool) -> DataFrame:
    """``members`` (pos, cluster, vec) with their clusters, at first of a ``single`` vector, merged down to ``level``."""
    # sims are compared as floats, and a level is one; only pairs at the threshold itself are cut by their doubles
    at_level = F.col("sim") >= F.lit(level) if last else F.col("sim").cast("float") >= F.lit(level).cast("float")
    found = linkage_rounds(cluster_pairs(members, level - 1e-6, single).where(at_level))
    return members.join(found.toDF("cluster", "new"), "cluster", "left").select("pos", F.coalesce("new", "cluster").alias("cluster"), "vec")


def linkage_rounds(pairs: DataFrame) -> DataFrame:
    """(pos, cluster) by complete linkage over ``pairs`` (a < b, sim, na, nb: sizes, else 1) at the threshold, of clusters that get another name.

    Two clusters that are each other's best partner (greatest least similarity, then the lowest pair) may merge at
    any time: complete linkage is reducible, so no later merge gives either a better one. Nor a lower pair of the same
    similarity, as a merged cluster has the name of one of its own, and both were partners. Each round merges all such
    pairs at once. A pair of clusters stays a pair only while all pairs of their members are pairs, and a cluster never
    leaves a connected component of what is left: few pairs, or small components after some rounds, are merged in a
    task each, in the same way.
    """
    if "na" not in pairs.columns:
        pairs = pairs.select("a", "b", "sim", F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb"))
    live = written(pairs.select("a", "b", F.col("sim").cast("float").alias("sim"), "na", "nb"))
    most, rounds, merges = PAIRS_A_VECTOR * MOST_LINKED, 0, []
    while left := live.count():
        if left <= most // 20:
            merges.append(written(_merged_in_tasks(live.withColumn("part", F.lit(0)))))
            break
        if rounds % (ROUNDS + 1) == ROUNDS:
            small, live = _split(live, most)
            merges.append(written(_merged_in_tasks(small)))
        else:
            merges.append(written(_best_pairs(live)))
            live = written(_after(live, merges[-1]))
        rounds += 1
    return _ends(live.sparkSession, merges)


def _split(live: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Of ``live`` pairs those in components of up to ``most`` pairs, with a part for all of a component, and the others."""
    rooted = written(live.join(components(live.select("a", "b")).select(F.col("v").alias("a"), "root"), "a"))
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n"))
    large = written(sizes.where(F.col("n") > most).select("root"))
    small = rooted.join(large, "root", "left_anti")
    parts = 1 + small.count() * 8 // most
    return small.withColumn("part", F.pmod(F.xxhash64("root"), F.lit(parts)).cast("int")).drop("root"), written(rooted.join(large, "root", "left_semi").select(live.columns))


def _merged_in_tasks(pairs: DataFrame) -> DataFrame:
    """(old, new) of all clusters of ``pairs`` (a, b, sim, na, nb, part: that of all pairs of a component) that get another name."""

    def merge(table: pa.Table) -> pa.Table:
        names, clusters = merged(*(table.column(c).to_numpy() for c in ("a", "b", "sim", "na", "nb")))
        moved = names != clusters
        return pa.table({"old": pa.array(names[moved], pa.int64()), "new": pa.array(clusters[moved], pa.int64())})

    return pairs.select("part", "a", "b", "sim", "na", "nb").groupBy("part").applyInArrow(merge, "old long, new long")


def _best_pairs(live: DataFrame) -> DataFrame:
    """(old, new, n: the merged cluster's size) of the pairs of ``live`` that are the best of both."""
    key = F.struct("sim", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"), "na", "nb")
    best = live.select(F.explode(F.array("a", "b")).alias("v"), key.alias("key")).groupBy("v").agg(F.max("key").alias("key"))
    agreed = best.groupBy("key").agg(F.count("*").alias("n")).where("n = 2")
    return agreed.select((-F.col("key.y")).alias("old"), (-F.col("key.x")).alias("new"), (F.col("key.na") + F.col("key.nb")).alias("n"))


def _after(live: DataFrame, merges: DataFrame) -> DataFrame:
    """``live`` pairs of clusters after ``merges`` (old, new, n: size): those all pairs of whose members were pairs."""
    moved = merges.select(F.explode(F.array("old", "new")).alias("v"), F.col("new").alias("to"), F.col("n").alias("size"))
    for side in ("a", "b"):
        live = live.join(moved.toDF(side, f"to_{side}", f"size_{side}"), side, "left")
    ends = [F.struct(F.coalesce(f"to_{c}", c).alias("v"), F.coalesce(f"size_{c}", f"n{c}").alias("n")) for c in "ab"]
    pairs = live.select("sim", (F.col("na") * F.col("nb")).alias("n"), F.array_sort(F.array(*ends)).alias("e")).where("e[0].v <> e[1].v")
    named = pairs.select(F.expr("e[0].v AS a"), F.expr("e[1].v AS b"), "sim", "n", F.expr("e[0].n AS na"), F.expr("e[1].n AS nb"))
    whole = named.groupBy("a", "b").agg(F.min("sim").alias("sim"), F.sum("n").alias("n"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return whole.where("n = na * nb").select("a", "b", "sim", "na", "nb")


def _ends(spark: SparkSession, merges: list[DataFrame]) -> DataFrame:
    """(pos, cluster): where chains of ``merges`` (old, new) end; a cluster goes into another once, so each doubling of steps halves what is left of a chain."""
    if not merges:
        return spark.createDataFrame([], "pos long, cluster long")
    steps = written(reduce(DataFrame.unionByName, [m.select("old", "new") for m in merges]))
    for _ in range((len(merges) - 1).bit_length()):
        steps = written(steps.join(steps.toDF("new", "next"), "new", "left").select("old", F.coalesce("next", "new").alias("new")))
    return steps.toDF("pos", "cluster")


def discover(docs: DataFrame, threshold: float = LINK, min_size: int = MIN_SIZE, terms: int = TERMS, label: str = "terms") -> DataFrame:
    """Topics of ``docs`` (pos, doc, vec, tokens, text): id, label, label_terms, members; the largest first."""
    placed = docs.join(complete_linkage(docs.select("pos", "vec"), threshold), "pos")
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc"))), lambda s: s["doc"].cast("string")).alias("members")).where(F.col("size") >= min_size)
    kept = written(placed.join(sizes.select("cluster"), "cluster", "left_semi"))
    named = distinctive_terms(kept.select("cluster", "doc"), docs.select("doc", "tokens"), terms)
    out = sizes.withColumn("id", cluster_id("members")).join(named.groupBy("cluster").agg(F.array_sort(F.collect_list("token")).alias("label_terms")), "cluster", "left")
    if label == "terms":
        out = out.withColumn("label", F.array_join("label_terms", " + "))
    else:
        out = out.join(centroid_titles(kept), "cluster", "left").withColumn("label", F.coalesce("title", F.array_join("label_terms", " + "))).drop("title")
    return out.orderBy(F.desc("size"), "cluster")


def centroid_titles(placed: DataFrame) -> DataFrame:
    """(cluster, title): the text of the member nearest the summed centroid, of those that have one; equal: the first."""
    centre = mean_pool(placed.select(F.col("cluster").alias("doc_id"), "vec")).select(F.col("doc_id").alias("cluster"), F.col("vec").alias("centre"))
    near = placed.where(F.trim("text") != "").join(centre, "cluster").withColumn("sim", dot(F.col("vec"), F.col("centre")))
    return near.groupBy("cluster").agg(cut_title(F.max_by("text", F.struct("sim", -F.col("pos")))).alias("title"))


def rescue_placed(placed: DataFrame, threshold: float = RESCUE) -> DataFrame:
    """rescue() of documents ``placed`` (doc, label: null for none, tokens): one count of tokens by label gives both document frequencies and the labels' tokens; labels are ordered by name."""
    counts = label_counts(placed, "label")
    idf = written(frequencies(counts, placed.count()).where("idf > 0").select("token", "idf"))
    order = counts.where("label IS NOT NULL").select("label").distinct().withColumn("ord", F.row_number().over(Window.orderBy("label")))  # one row a label
    return _rescued(placed.select("doc", "label"), placed.where("label IS NULL").select("doc", "tokens"), counts.join(order, "label"), idf, threshold)


def rescue(labels: DataFrame, tokens: DataFrame, cluster_tokens: DataFrame, threshold: float = RESCUE) -> DataFrame:
    """Unlabelled documents to the cluster of greatest tf-idf cosine, if it is over 0 and at least ``threshold``.

    ``labels`` (doc, label), ``tokens`` (doc, distinct tokens) of all documents, ``cluster_tokens`` (label, ord, token,
    n: how many of its documents have it), or (label, ord, tokens) of a few small ones. Documents and clusters meet by shared tokens; N counts all documents, also
    those without tokens. A token that all documents have weighs nothing, so a word that is everywhere joins nothing.
    """
    if "tokens" in cluster_tokens.columns:
        cluster_tokens = cluster_tokens.select("label", "ord", F.explode("tokens").alias("token")).groupBy("label", "ord", "token").agg(F.count("*").alias("n"))
    idf = inverse_frequency(tokens).where("idf > 0").select("token", "idf")
    return _rescued(labels, labels.where("label IS NULL").select("doc").join(tokens, "doc"), cluster_tokens, idf, threshold)


def _rescued(labels: DataFrame, open_: DataFrame, cluster_tokens: DataFrame, idf: DataFrame, threshold: float) -> DataFrame:
    docs = written(open_.select("doc", F.explode("tokens").alias("token")).join(idf, "token").select("doc", "token", F.col("idf").alias("w")))
    clusters = written(cluster_tokens.join(idf, "token").select(F.col("label").alias("to"), "ord", "token", (F.col("n") * F.col("idf")).alias("w")))
    norm = lambda df, key, name: df.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(name))
    names = clusters.select("ord", "to").distinct()
    dots = docs.select("doc", "token", F.col("w").alias("a")).join(clusters.select("ord", "token", F.col("w").alias("b")), "token").groupBy("doc", "ord").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    sims = dots.join(norm(docs, "doc", "na"), "doc").join(norm(clusters, "ord", "nb"), "ord").where("na > 0 AND nb > 0").withColumn("sim", F.col("dot") / (F.col("na") * F.col("nb")))
    best = sims.groupBy("doc").agg(F.max(F.struct(F.round("sim", 9).alias("sim"), (-F.col("ord")).alias("o"))).alias("b")).where((F.col("b.sim") > 0) & (F.col("b.sim") >= threshold))
    best = best.select("doc", "b.sim", (-F.col("b.o")).alias("ord")).join(names, "ord")
    return labels.join(best, "doc", "left").select("doc", F.coalesce("label", "to").alias("label"), F.when(F.col("label").isNull(), F.col("sim")).alias("rescued_at"))


def coherence(top_terms: DataFrame, tokens: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """UMass coherence of each cluster: the mean over its term pairs i < j of ln((co + 1) / df_j). Needs two terms.

    Only candidate terms are joined, so documents pair the few terms that some cluster asks for.
    """
    terms = written(top_terms.where(F.col("rank") <= top_n).select("cluster", "token", "rank"))
    wanted = terms.select("token").distinct()
    has = written(tokens.select("doc", F.explode("tokens").alias("token")).join(wanted, "token", "left_semi"))
    df = has.groupBy("token").agg(F.count("*").alias("df"))
    pairs = terms.select("cluster", F.col("token").alias("a"), F.col("rank").alias("i")).join(terms.select("cluster", F.col("token").alias("b"), F.col("rank").alias("j")), "cluster").where("i < j")
    asked = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    both = has.select("doc", F.col("token").alias("x")).join(asked, "x").join(has.select("doc", F.col("token").alias("y")), ["doc", "y"]).groupBy("x", "y").agg(F.count("*").alias("co"))
    scored = pairs.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b")).join(both, ["x", "y"], "left").join(df.select(F.col("token").alias("b"), "df"), "b")
    return scored.groupBy("cluster").agg(F.avg(F.ln((F.coalesce("co", F.lit(0)) + 1) / F.col("df"))).alias("coherence"), F.count("*").alias("pairs"))


def kmeans(docs: DataFrame, k: int, seed: int = 42, max_iter: int = 100, min_size: int = MIN_SIZE) -> DataFrame:
    """(doc, cluster) by k-means on the vectors; clusters under ``min_size`` are dropped."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = docs.select("doc", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    found = KMeans(k=k, seed=seed, maxIter=max_iter).fit(rows).transform(rows).select("doc", F.col("prediction").alias("cluster"))
    return found.join(found.groupBy("cluster").count().where(F.col("count") >= min_size).select("cluster"), "cluster", "left_semi")


def kmeans_labels(placed: DataFrame, tokens: DataFrame, k: int = TERMS) -> DataFrame:
    """(cluster, label, size) for ``placed`` (doc, cluster) and ``tokens`` (doc, tokens, repeats allowed): the tokens of most members, then most uses, then by name."""
    # one list a document, so its distinct tokens are known within its row, and only sums by cluster and token are shuffled
    listed = placed.join(tokens, "doc").groupBy("cluster", "doc").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    mark = lambda c, docs, uses: F.transform(c, lambda t: F.struct(t.alias("token"), F.lit(docs).alias("docs"), F.lit(uses).alias("uses")))
    used = listed.select("cluster", F.inline(F.concat(mark(F.array_distinct("tokens"), 1, 0), mark(F.col("tokens"), 0, 1))))
    counts = used.groupBy("cluster", "token").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("total"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("docs"), F.desc("total"), "token"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= k)
    names = top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda s: s["token"]), " + ").alias("label"))
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.join(names, "cluster", "left").select("cluster", F.coalesce("label", F.lit("")).alias("label"), "size")


def plane(docs: DataFrame, dims: int = 2) -> DataFrame:
    """(doc, at: dims numbers) by the principal components of ``docs`` (doc, vec): the nearest that Spark has to a neighbour embedding."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = docs.select("doc", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    return PCA(k=dims, inputCol="features", outputCol="out").fit(rows).transform(rows).select("doc", vector_to_array("out").alias("at"))


def hybrid_labels(docs: DataFrame, chunks: DataFrame, centroids: DataFrame, threshold: float = 0.38, margin: float = 0.02, link: float = LINK, min_size: int = 4) -> DataFrame:
    """(doc, label): nearest centroids first, then topics discovered among the abstentions ('~' labels, only with enough of them), then the rescue."""
    known = nearest(chunks.withColumnRenamed("doc", "doc_id"), centroids, threshold, margin).select(F.col("doc_id").alias("doc"), "label")
    labels = written(docs.select("doc").join(known, "doc", "left"))
    open_ = docs.join(labels.where("label IS NULL").select("doc"), "doc", "left_semi").where(F.size("tokens") >= MIN_TOKENS)
    if open_.limit(MIN_INPUTS).count() >= MIN_INPUTS:
        topics = written(discover(open_, link, min_size).select("label", F.explode("members").alias("_doc")))
        found = topics.groupBy("_doc").agg(F.concat(F.lit("~"), F.min("label")).alias("topic"))
        labels = written(labels.join(found, labels["doc"].cast("string") == F.col("_doc"), "left").select("doc", F.coalesce("label", "topic").alias("label")))
    return rescue_placed(docs.select("doc", "tokens").join(labels, "doc")).select("doc", "label")


def group_tokens(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """(label, ord, token, n) of labelled documents: how many of a label's documents have a token; ord: the place of the label's name."""
    counts = labels.where("label IS NOT NULL").join(docs.select("doc", "tokens"), "doc").select("label", F.explode("tokens").alias("token")).groupBy("label", "token").agg(F.count("*").alias("n"))
    order = labels.where("label IS NOT NULL").select("label").distinct().withColumn("ord", F.row_number().over(Window.orderBy("label")))  # one row a label
    return counts.join(order, "label")
