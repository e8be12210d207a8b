"""Embedding near-dedup: epsilon grid order join on leading principal dimensions (operator 2).

Two unit vectors with cosine >= c are at most eps = sqrt(2 - 2c) apart. Equal vectors are one class first. Classes are
sorted by the cells of a grid of width eps on GRID_DIMS leading principal dimensions (the epsilon grid order) and cut
into blocks. A vector's coordinates are its projections on BOUND_DIMS principal dimensions and the length of what is
left of it; the distance of two vectors is at least that of their coordinates, so two intervals of the order are
provably distant if the squared gaps of their boxes of coordinates, summed over all of them, exceed eps squared. Blocks
that are provably distant never meet; a pair of blocks is joined by halving both sequence intervals, skipping distant
halves, down to small dense products in double precision. It gives each class's number of links and a spanning forest
of its links, never all pairs. A block moves once for each block near to it, so blocks are as large as memory allows
(BLOCK vectors), and what is skipped within them doesn't move.

Results defined for odd input: vectors that are null, empty, zero, or hold null or non-finite components, and
those with a null label, link with nothing and are their own component; vectors of different dimension don't
compare; repeated rows count as vectors of their own (equal, so linked); null vec_ids are rows of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, fingerprint, materialize, read_table
from .graph import components

COSINE = 0.98
#: Principal dimensions of the grid and of the bounds, vectors a block, and vectors an interval that is compared whole.
GRID_DIMS, BOUND_DIMS, BLOCK, LEAF = 8, 24, 4096, 64
#: Squared gaps must exceed eps squared by this much, for rounding.
SAFETY = 1e-9


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return _unit(x)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension of vectors the leading eigenvectors of their second moments, summed over all classes."""

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                x = _matrix(batch.column("vec").filter(pa.array(lengths == dim)), dim)
                x1 = np.hstack([x, np.ones((len(x), 1))])
                sums[dim] = sums.get(dim, 0) + x1.T @ x1
        for dim, m in sums.items():
            yield pa.record_batch([pa.array(np.full(m.size, dim, np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], names=["dim", "at", "s"])

    out = {}
    parts: dict[int, np.ndarray] = {}
    # (d + 1) ** 2 sums for each dimension d that occurs
    for r in classes.select("vec").mapInArrow(moments, "dim int, at int, s double").groupBy("dim", "at").agg(F.sum("s").alias("s")).collect():
        parts.setdefault(r["dim"], np.zeros((r["dim"] + 1) ** 2))[r["at"]] = r["s"]
    for dim, flat in parts.items():
        m = flat.reshape(dim + 1, dim + 1)
        mean = m[-1, :-1] / m[-1, -1]
        values, vectors = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))
        out[dim] = vectors[:, np.argsort(-values)[:BOUND_DIMS]]
    return out


def coordinates(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Projections on the axes, and the length of the rest."""
    p = unit @ axes
    return np.hstack([p, np.sqrt(np.maximum(1 - (p * p).sum(axis=1, keepdims=True), 0))])


def ordered_blocks(classes: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Classes in epsilon grid order, cut into blocks with the bounds of their coordinates."""
    keyed = "cid long, label string, dim int, n long, vec array<double>, key binary"

    def key(batches):
        for batch in batches:
            lengths = batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
            keys = np.empty(batch.num_rows, object)
            for dim in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == dim)
                cells = np.floor(_matrix(batch.column("vec").take(pa.array(mine)), dim) @ axes[dim][:, :GRID_DIMS] / eps).astype(np.int64) + (1 << 15)
                raw = cells.astype(">u2")
                for i, row in zip(mine, raw, strict=True):
                    keys[i] = row.tobytes()
            yield pa.record_batch([batch.column("cid"), batch.column("label"), pa.array(lengths.astype(np.int32)), batch.column("n"), batch.column("vec"), pa.array(keys, pa.binary())], names=["cid", "label", "dim", "n", "vec", "key"])

    keyed = keyed.replace("array<double>", classes.schema["vec"].dataType.simpleString())
    blocked = "first_cid long, label string, dim int, lo array<double>, hi array<double>, cids binary, counts binary, vecs binary"

    def cut(batches):
        held: list[tuple] = []

        def block():
            vecs = np.array([r[4] for r in held])
            place = coordinates(_unit(vecs.astype(np.float64)), axes[held[0][2]])
            return pa.RecordBatch.from_pylist([{
                "first_cid": held[0][0], "label": held[0][1], "dim": held[0][2], "lo": place.min(axis=0).tolist(), "hi": place.max(axis=0).tolist(),
                "cids": np.array([r[0] for r in held], np.int64).tobytes(), "counts": np.array([r[3] for r in held], np.int64).tobytes(), "vecs": vecs.astype("<f4" if (vecs == vecs.astype("<f4")).all() else "<f8").tobytes(),
            }], schema=arrow_type(blocked))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) >= BLOCK or row[1:3] != held[0][1:3]):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    order = ["label", "dim", "key", "cid"]
    return materialize(classes.mapInArrow(key, keyed).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, blocked), "blocks")


def near_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs (a <= b) of blocks of a label whose boxes are at most eps apart. They meet by equal cells of the leading dimension, not by a cross join."""
    cell = lambda c, more: F.floor(F.get(c, F.lit(0)) / F.lit(eps)).cast("int") + more
    box = blocks.select("first_cid", "label", "dim", "lo", "hi")
    left = box.select("label", "dim", F.explode(F.sequence(cell("lo", 0), cell("hi", 0))).alias("c"), F.col("first_cid").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    right = box.select("label", "dim", F.explode(F.sequence(cell("lo", -1), cell("hi", 1))).alias("c"), F.col("first_cid").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    gap = lambda lo, hi: F.aggregate(F.zip_with(lo, hi, lambda x, y: F.greatest(x - y, F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
    near = gap("alo", "bhi") + gap("blo", "ahi") <= eps * eps + SAFETY  # of a dimension one gap at most isn't 0
    return left.join(right, ["label", "dim", "c"]).where((F.col("a") <= F.col("b")) & near).select("a", "b").distinct()


def _tree(place: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Bounds of the intervals that halving makes."""
    out = {}

    def build(i0: int, i1: int) -> tuple[np.ndarray, np.ndarray]:
        if i1 - i0 <= LEAF:
            out[i0, i1] = place[i0:i1].min(axis=0), place[i0:i1].max(axis=0)
        else:
            mid = (i0 + i1) // 2
            (al, ah), (bl, bh) = build(i0, mid), build(mid, i1)
            out[i0, i1] = np.minimum(al, bl), np.maximum(ah, bh)
        return out[i0, i1]

    build(0, len(place))
    return out


def _descend(x, y, tx, ty, i, j, cosine, same, found) -> int:
    """Links between the intervals i of x and j of y, by halving the longer one; how many pairs were compared."""
    (i0, i1), (j0, j1) = i, j
    if same and j1 <= i0:
        return 0
    (xl, xh), (yl, yh) = tx[i], ty[j]
    gaps = np.maximum(np.maximum(xl - yh, yl - xh), 0)
    if gaps @ gaps > 2 - 2 * cosine + SAFETY:
        return 0
    if max(i1 - i0, j1 - j0) <= LEAF:
        p, q = np.nonzero(x[i0:i1] @ y[j0:j1].T >= cosine)
        p, q = p + i0, q + j0
        if same:
            p, q = p[p < q], q[p < q]
        if len(p):
            found.append((p, q))
        return (i1 - i0) * (j1 - j0)
    if i1 - i0 >= j1 - j0:
        mid = (i0 + i1) // 2
        return _descend(x, y, tx, ty, (i0, mid), j, cosine, same, found) + _descend(x, y, tx, ty, (mid, i1), j, cosine, same, found)
    mid = (j0 + j1) // 2
    return _descend(x, y, tx, ty, i, (j0, mid), cosine, same, found) + _descend(x, y, tx, ty, i, (mid, j1), cosine, same, found)


def forest(p: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each of n vertices to the least vertex that the links (p, q) connect it with."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[p], low[q])
        new = low.copy()
        np.minimum.at(new, p, least)
        np.minimum.at(new, q, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    at = np.flatnonzero(low != np.arange(n))
    return low[at], at


def join_blocks(pairs: DataFrame, axes: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """Rows (x, y, n): y null and n the links of class x found here, or an edge x - y of a spanning forest."""
    out = "x long, y long, n long"

    def side(row, k):
        cids = np.frombuffer(row[f"cids{k}"], np.int64)
        raw = row[f"vecs{k}"]
        vecs = _unit(np.frombuffer(raw, "<f4" if len(raw) == 4 * len(cids) * row["dim"] else "<f8").reshape(len(cids), -1).astype(np.float64))
        return cids, np.frombuffer(row[f"counts{k}"], np.int64), vecs, _tree(coordinates(vecs, axes[row["dim"]]))

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                same = row["a"] == row["b"]
                ids1, n1, x, tx = side(row, 1)
                ids2, n2, y, ty = (ids1, n1, x, tx) if same else side(row, 2)
                found: list[tuple[np.ndarray, np.ndarray]] = []
                _descend(x, y, tx, ty, (0, len(x)), (0, len(y)), cosine, same, found)
                if not found:
                    continue
                p, q = (np.concatenate(z) for z in zip(*found, strict=True))
                ids, counts = (ids1, n1) if same else (np.concatenate([ids1, ids2]), np.concatenate([n1, n2]))
                q = q if same else q + len(ids1)
                links = np.bincount(p, weights=counts[q], minlength=len(ids)) + np.bincount(q, weights=counts[p], minlength=len(ids))
                a, b = forest(p, q, len(ids))
                some = np.flatnonzero(links)
                xs, ys = np.concatenate([ids[some], ids[a]]), np.concatenate([np.zeros(len(some), np.int64), ids[b]])
                yield pa.record_batch([pa.array(xs), pa.array(ys, mask=np.arange(len(xs)) < len(some)), pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(a), np.int64)]))], schema=arrow_type(out))

    return pairs.mapInArrow(run, out)


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding, label)."""
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    kind = vectors.schema["embedding"].dataType
    vec = F.col("embedding") if kind.simpleString() in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vec.alias("vec")).withColumn("good", good)
    f1, f2 = fingerprint(F.col("label"), F.col("vec"))
    rows = rows.withColumn("f1", F.when(F.col("good"), f1)).withColumn("f2", F.when(F.col("good"), f2))
    grouped = rows.where("good").groupBy("f1", "f2").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    eps = float(np.sqrt(2 - 2 * cosine))
    axes = principal_axes(classes)
    blocks = ordered_blocks(classes.select("cid", "label", "n", "vec"), axes, eps)
    side = lambda k, name: blocks.select(F.col("first_cid").alias(name), *([F.col("dim")] if k == 1 else []), *(F.col(c).alias(f"{c}{k}") for c in ("vecs", "cids", "counts")))
    near = materialize(near_blocks(blocks, eps), "near-blocks")
    found = materialize(join_blocks(near.join(side(1, "a"), "a").join(side(2, "b"), "b"), axes, cosine), "links")
    links = found.where("y IS NULL").groupBy(F.col("x").alias("cid")).agg(F.sum("n").alias("links"))
    roots = components(found.where("y IS NOT NULL").select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("v", "cid")
    placed = materialize(classes.drop("vec", "label").join(links, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "class-roots")
    least = materialize(placed.groupBy("root").agg(F.min("least").alias("component")), "component-ids")
    known = materialize(placed.join(least, "root").select("f1", "f2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"), "class-results")
    done = rows.select("vec_id", "f1", "f2").join(known, ["f1", "f2"], "left")
    component = F.coalesce("component", "vec_id")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op2_epsilon_grid(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM link
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM v LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
"""
