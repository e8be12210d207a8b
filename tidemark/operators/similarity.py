"""Similarity of unit vectors: dot products, nearest centroids with abstention, chunks, mean pooling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

THRESHOLD, MARGIN = 0.40, 0.02
#: Centroids that may go to every task, and those in one row.
MOST_CENTROIDS, MOST_PACKED = 50_000, 1_000
#: Vectors a block of the blocked join, reference vectors, groups of a block's partners, and what angles and products may be off by rounding.
BLOCK, REFERENCES, PARTNERS, ROUNDING = 2048, 64, 8, 1e-9
#: Bits of a block's number within its run of blocks: a task holds a run, and each partner moves once to all of it. Blocks of vectors a partition, so that most partitions are one run.
RUN_BITS, RUN_FILL = 4, 12
#: Dot products at a time, and products of two clusters from which they are a matrix product.
AT_ONCE, MANY = 65_536, 1_024


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def centroid_similarities(vectors: DataFrame, centroids: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, ord, centroid_id, sim): the greatest over the chunks of a document. ``centroids`` (centroid_id, ord, vec) is a dimension: labels or projects, not rows of the corpus."""
    # packed to rows of MOST_PACKED, so each vector meets some centroids at a time in its own task, and chunks are combined before the shuffle
    rows = centroids.count()
    if rows > MOST_CENTROIDS:
        raise ValueError(f"{rows} centroids are no dimension: join blocks of them (pairs_in_blocks) instead")
    packed = centroids.withColumn("_g", F.pmod(F.xxhash64("centroid_id"), F.lit(-(-max(rows, 1) // MOST_PACKED)))).groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("ord", "centroid_id", "vec"))).alias("_cs"))
    pairs = vectors.crossJoin(F.broadcast(packed.drop("_g"))).select(doc, "vec", F.explode("_cs").alias("c"))  # bounded by MOST_CENTROIDS
    return pairs.select(doc, F.col("c.ord").alias("ord"), F.col("c.centroid_id").alias("centroid_id"), dot(F.col("vec"), F.col("c.vec")).alias("sim")).groupBy(doc, "ord", "centroid_id").agg(F.max("sim").alias("sim"))


def nearest(vectors: DataFrame, centroids: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, doc: str = "doc_id") -> DataFrame:
    """The nearest centroid of each document, or none below ``threshold`` or within ``margin`` of the second best. Equal similarity: the first centroid."""
    sims = centroid_similarities(vectors, centroids, doc)
    # best and second best by aggregates over the few centroids of a document, without a sort
    top = sims.groupBy(doc).agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", (-F.col("ord")).alias("back"), "centroid_id")), asc=False), 1, 2).alias("t"))
    best, second = F.col("t")[0], F.get("t", F.lit(1))
    sure = (best["sim"] >= threshold) & (second.isNull() | (best["sim"] - second["sim"] >= margin))
    return top.select(doc, F.when(sure, best["centroid_id"]).alias("label"), best["sim"].alias("similarity"), second["sim"].alias("runner_up"))


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64()), ("n", pa.int64())])
_PAIRS_DDL = "a long, b long, sim double, n long"


class _Block:
    """Vectors of a block, and what its products need: names, the places and counts of their vectors, the mean of each name's vectors for the first look, and what single precision may be off by."""

    def __init__(self, at: np.ndarray, x: np.ndarray, clusters: bool):
        self.x = x
        self.first = np.flatnonzero(np.diff(at, prepend=at[0] - 1)) if clusters else np.arange(len(at))
        self.counts = np.diff(self.first, append=len(at))
        self.names = at[self.first]
        means = np.add.reduceat(x.astype(np.float64), self.first) / self.counts[:, None] if len(self.first) < len(at) else x
        lengths = np.sqrt(np.square(x, dtype=np.float64).sum(axis=1))
        self.top = float(lengths[np.isfinite(lengths)].max(initial=0))
        # lengths beyond this may overflow single precision
        self.means = means.astype(np.float32 if self.top < 1e15 else np.float64)


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero() of a matrix that is mostly false, eight at a time."""
    flat = mask.ravel()
    even = len(flat) // 8 * 8
    some = (np.flatnonzero(flat[:even].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(np.concatenate([some[flat[some]], even + np.flatnonzero(flat[even:])]), mask.shape[1])


def _dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of rows in double precision, AT_ONCE at a time."""
    return np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", x[i[k : k + AT_ONCE]].astype(np.float64), y[j[k : k + AT_ONCE]].astype(np.float64)) for k in range(0, len(i), AT_ONCE))])


def _least(p: _Block, i: np.ndarray, q: _Block, j: np.ndarray) -> np.ndarray:
    """The least dot product of the vectors of names i and j."""
    n, out = p.counts[i] * q.counts[j], np.empty(len(i))
    for k in np.flatnonzero(n > MANY):
        a, b = p.first[i[k]], q.first[j[k]]
        out[k] = (p.x[a : a + p.counts[i[k]]].astype(np.float64) @ q.x[b : b + q.counts[j[k]]].astype(np.float64).T).min()
    few = np.flatnonzero(n <= MANY)
    ends = np.cumsum(n[few])
    for part in np.split(few, np.searchsorted(ends, np.arange(AT_ONCE, ends[-1], AT_ONCE)) if len(few) else []):
        if len(part):
            starts = np.cumsum(n[part]) - n[part]
            of = np.repeat(np.arange(len(part)), n[part])
            r, c = np.divmod(np.arange(len(of)) - starts[of], q.counts[j[part]][of])
            out[part] = np.minimum.reduceat(_dots(p.x, p.first[i[part]][of] + r, q.x, q.first[j[part]][of] + c), starts)
    return out


def _products(p: _Block, q: _Block, threshold: float) -> pa.RecordBatch:
    """Pairs at the threshold of two blocks, each pair once, the lower name first; the least product of names of several vectors counts, n tells of how many.

    The least product is at most that of the means, so single precision products of means, less what they may be off
    by, tell which pairs to look at; those are decided in double precision from the vectors.
    """
    off = (p.x.shape[1] + 8) * (1e-12 if p.means.dtype == q.means.dtype == np.float64 else 1.2e-7) * p.top * q.top
    with np.errstate(over="ignore", invalid="ignore"):
        s = p.means @ q.means.T
        i, j = _places(s >= np.nextafter(s.dtype.type(threshold - off), s.dtype.type(-np.inf)))
        keep = p.names[i] < q.names[j] if p is q else p.names[i] != q.names[j]
        i, j = i[keep], j[keep]
        sims = _dots(p.x, p.first[i], q.x, q.first[j])
        keep = sims >= threshold
        i, j, sims = i[keep], j[keep], sims[keep]
        n = p.counts[i] * q.counts[j]
        several = np.flatnonzero(n > 1)
        if len(several):
            sims[several] = _least(p, i[several], q, j[several])
            keep = sims >= threshold
            i, j, sims, n = i[keep], j[keep], sims[keep], n[keep]
    a, b = p.names[i], q.names[j]
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sims), pa.array(n)], schema=_PAIRS)


def _matrix(column) -> np.ndarray:
    lengths = pc.list_value_length(column)
    if len(column) and not column.null_count and pc.min(lengths) == pc.max(lengths):
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def pairs_in_blocks(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) for a < b of ``vectors`` (pos, vec) with a dot product of ``threshold`` or more."""
    return pairs_within(vectors.select(F.lit(0).alias("within"), F.col("pos").cast("long").alias("pos"), "vec"), threshold)


def pairs_within(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) for a < b of ``vectors`` (within, pos, vec) that agree in ``within``, with a dot product of ``threshold`` or more.

    Up to BLOCK vectors are one matrix product for each ``within``. More are cut into blocks around reference vectors
    (blocks()); pairs of blocks that are provably too far apart by the triangle inequality of angles never meet, the
    others are matrix products. Vectors without ``within`` have no pairs.
    """
    return _within(vectors, threshold).select("a", "b", "sim")


def cluster_pairs(members: DataFrame, threshold: float, single: bool = False) -> DataFrame:
    """(a, b, sim, na, nb) for clusters a < b of ``members`` (cluster, pos, vec), all pairs of whose members have a dot product of ``threshold`` or more; sim is the least, na and nb are sizes. ``single``: all clusters have one member.

    Clusters are named by their first member and lie together in blocks, so pairs of members are reduced where they
    are multiplied; what a cluster over several blocks gives is put together by the counts of its pairs.
    """
    one = F.lit(1).cast("long")
    if single:
        return _within(members.select(F.lit(0).alias("within"), F.col("cluster").alias("pos"), "vec"), threshold).select("a", "b", "sim", one.alias("na"), one.alias("nb"))
    found = _within(members.select(F.lit(0).alias("within"), "pos", "cluster", "vec"), threshold).groupBy("a", "b").agg(F.min("sim").alias("sim"), F.sum("n").alias("n"))
    sizes = written(members.groupBy("cluster").agg(F.count("*").alias("n")))
    of = lambda side: sizes.select(F.col("cluster").alias(side), F.col("n").alias(f"n{side}"))
    return found.join(of("a"), "a").join(of("b"), "b").where("n = na * nb").select("a", "b", "sim", "na", "nb")


def _within(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim, n): pairs_within() with positions, or with clusters instead of them where there is a column of that name."""
    vectors, clusters = vectors.where("within IS NOT NULL"), "cluster" in vectors.columns
    n = vectors.count()
    if n > BLOCK:
        cut = blocks(vectors, n)
        return products(cut, near_blocks(cut, threshold), threshold, clusters, _packed_as(vectors))
    if clusters:
        vectors = vectors.select("within", F.col("cluster").alias("pos"), "vec")

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        block = _Block(table.column("pos").to_numpy(), _matrix(table.column("vec")), clusters)
        return pa.Table.from_batches([_products(block, block, threshold)])

    return vectors.groupBy("within").applyInArrow(whole, _PAIRS_DDL)


def _packed_as(vectors: DataFrame) -> type:
    return np.float32 if vectors.schema["vec"].dataType.elementType.simpleString() == "float" else np.float64


def _angles(x: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of vectors to the reference vectors, and their lengths; a vector without length has a right angle to all."""
    norm = np.sqrt((x * x).sum(axis=1))
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    return np.arccos(np.clip(unit @ references.T, -1, 1)), norm


def blocks(vectors: DataFrame, n: int | None = None) -> DataFrame:
    """Vectors in blocks of up to BLOCK: within, block, cell (the nearest reference vector), lo and hi (the block's least and greatest angle to each reference), top (the greatest length), and the packed pos and vecs. Written.

    References are REFERENCES vectors by hash. Vectors are sorted by cell and angle to its reference, so blocks are
    rings around references. With a column cluster, that stands for pos, and all members lie where the first one lies.
    ``n``: how many vectors there are. Vectors of floats are packed as such.
    """
    kept, parts = _packed_as(vectors), -(-(vectors.count() if n is None else n) // (BLOCK * RUN_FILL))
    # REFERENCES rows
    chosen = vectors.orderBy(F.xxhash64("pos"), "pos").select("vec").limit(REFERENCES).collect()
    references = np.array([r["vec"] for r in chosen], np.float64)
    norms = np.sqrt((references * references).sum(axis=1, keepdims=True))
    references = (references / np.where(norms > 0, norms, 1))[norms[:, 0] > 0]

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                angles, _ = _angles(_matrix(batch.column("vec")), references)
                cell = angles.argmin(axis=1) if len(references) else np.zeros(batch.num_rows, np.int64)
                near = angles.min(axis=1) if len(references) else np.zeros(batch.num_rows)
                yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(near)], names=[*batch.schema.names, "cell", "near"])

    def cut(batches):
        held, number = [], TaskContext.get().partitionId() << 40

        def block():
            x = np.stack([r[2] for r in held])
            angles, norm = _angles(x, references)
            return pa.record_batch([
                pa.array([held[0][0]], types["within"]), pa.array([number]), pa.array([held[0][3]], pa.int32()), pa.array([angles.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([angles.max(axis=0).tolist()], pa.list_(pa.float64())),
                pa.array([float(norm.max())]), pa.array([np.array([r[1] for r in held], np.int64).tobytes()], pa.binary()), pa.array([x.astype(kept).tobytes()], pa.binary()),
            ], names=["within", "block", "cell", "lo", "hi", "top", "pos", "vecs"])

        types = {}
        for batch in batches:
            types["within"] = batch.schema.field("within").type
            for row in zip(batch.column("within").to_pylist(), batch.column("pos").to_pylist(), _matrix(batch.column("vec")), batch.column("cell").to_pylist(), strict=True):
                if held and (len(held) >= BLOCK or (row[0], row[3]) != (held[0][0], held[0][3])):
                    yield block()
                    held, number = [], number + 1
                held.append(row)
        if held:
            yield block()

    kind = vectors.schema["within"].dataType.simpleString()
    placed = vectors.select("within", F.col("pos").cast("long").alias("pos"), "vec").mapInArrow(place, f"within {kind}, pos long, vec {vectors.schema['vec'].dataType.simpleString()}, cell int, near double")
    if "cluster" in vectors.columns:
        firsts = placed.join(vectors.where("pos = cluster").select("pos"), "pos", "left_semi").select(F.col("pos").alias("cluster"), "cell", "near")
        placed = vectors.join(firsts, "cluster").select("within", F.col("cluster").alias("pos"), "vec", "cell", "near")
    order = ["within", "cell", "near", "pos"]
    return written(placed.repartitionByRange(max(parts, 1), *order).sortWithinPartitions(*order).mapInArrow(cut, f"within {kind}, block long, cell int, lo array<double>, hi array<double>, top double, pos binary, vecs binary"))


def _too_far(a: str, b: str, threshold: float) -> Column:
    """Whether no vectors of two boxes of angles can have such a dot product: for every reference, two angles to it differ by no more than the angle between the vectors."""
    gaps = F.zip_with(F.zip_with(f"{a}.lo", f"{b}.hi", lambda x, y: x - y), F.zip_with(f"{b}.lo", f"{a}.hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.coalesce(F.array_max(gaps), F.lit(0.0))
    return F.lit(threshold > 0) & (F.col(f"{a}.top") * F.col(f"{b}.top") * F.cos(F.greatest(apart - ROUNDING, F.lit(0.0))) < threshold - ROUNDING)


def near_blocks(cut: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of blocks, a <= b, that may hold a pair of vectors; pairs of cells first, of which there are REFERENCES squared at most for each ``within``."""
    boxes = cut.select("within", "block", "cell", "lo", "hi", "top")
    n = REFERENCES
    span = boxes.groupBy("within", "cell").agg(F.max("top").alias("top"), *[F.min(F.get("lo", F.lit(k))).alias(f"l{k}") for k in range(n)], *[F.max(F.get("hi", F.lit(k))).alias(f"h{k}") for k in range(n)])
    some = lambda p: F.filter(F.array(*[F.col(f"{p}{k}") for k in range(n)]), lambda x: x.isNotNull())
    cells = written(span.select("within", "cell", "top", some("l").alias("lo"), some("h").alias("hi")))
    pairs = cells.alias("a").join(cells.alias("b"), F.expr("a.within = b.within AND a.cell <= b.cell")).where(~_too_far("a", "b", threshold)).select("a.within", F.col("a.cell").alias("ca"), F.col("b.cell").alias("cb"))
    left, right = boxes.withColumnRenamed("cell", "ca").alias("a"), boxes.withColumnRenamed("cell", "cb").alias("b")
    found = pairs.join(left, ["within", "ca"]).join(right, ["within", "cb"]).where(~_too_far("a", "b", threshold))
    one = found.where(F.expr("ca <> cb OR a.block <= b.block"))
    return one.select(F.col("a.block").alias("a"), F.col("b.block").alias("b"))


def products(cut: DataFrame, near: DataFrame, threshold: float, clusters: bool = False, kept: type = np.float64) -> DataFrame:
    """(a, b, sim, n): the pairs of vectors of pairs of blocks. A run of blocks moves once to each group of its partners, and before them, and a partner once to a run, so a task holds a run and a block."""
    run = F.shiftright("a", RUN_BITS).alias("run")
    near = written(near.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTNERS)).cast("int")).select(run, "part", "a", "b"))
    load = cut.select("block", "pos", "vecs")
    asked = near.groupBy("run", "part", "b").agg(F.collect_list("a").alias("met"))
    others = asked.join(load.withColumnRenamed("block", "b"), "b").select("run", "part", F.lit(1).alias("turn"), "met", "b", "pos", "vecs")
    own = near.select("run", "part", F.col("a").alias("b")).distinct().join(load.withColumnRenamed("block", "b"), "b").select("run", "part", F.lit(0).alias("turn"), F.array().cast("array<long>").alias("met"), "b", "pos", "vecs")

    def multiply(batches):
        group, mine = None, {}
        for batch in batches:
            for run, part, turn, met, b, pos, vecs in zip(*(batch.column(c).to_pylist() for c in ("run", "part", "turn", "met", "b", "pos", "vecs")), strict=True):
                if (run, part) != group:
                    group, mine = (run, part), {}
                if turn == 0 or met != [b]:
                    at = np.frombuffer(pos, np.int64)
                    block = _Block(at, np.frombuffer(vecs, kept).reshape(len(at), -1), clusters)
                if turn == 0:
                    mine[b] = block
                for a in met:
                    yield _products(mine[a], mine[a] if a == b else block, threshold)

    return others.unionByName(own).repartition("run", "part").sortWithinPartitions("run", "part", "turn").mapInArrow(multiply, _PAIRS_DDL)


def share_excluded(vectors: DataFrame, threshold: float) -> float:
    """The share of pairs of vectors, counting a vector with itself, whose blocks never meet."""
    cut = blocks(vectors)
    sizes = cut.select("within", "block", (F.length("pos") / 8).alias("n"))
    met = near_blocks(cut, threshold).join(sizes.select(F.col("block").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("block").alias("b"), F.col("n").alias("nb")), "b")
    pairs = met.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") + 1) / 2).otherwise(F.col("na") * F.col("nb")))).first()[0]
    every = sizes.groupBy("within").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()[0]
    return 1 - (pairs or 0) / every


def mean_pool(vectors: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The normalised mean of a document's vectors; null if it is zero."""
    means = vectors.select(doc, F.posexplode("vec").alias("at", "x")).groupBy(doc, "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vec = means.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return vec.withColumn("_n", norm).select(doc, F.when(F.col("_n") > 0, F.transform("v", lambda x: x / F.col("_n"))).alias("vec"))


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", within: str = "label") -> DataFrame:
    """Pairs a < b of one ``within`` value with a similarity of ``threshold`` or more."""
    return pairs_within(vectors.select(F.col(within).alias("within"), F.col(key).cast("long").alias("pos"), "vec"), threshold)
