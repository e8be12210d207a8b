"""Embedding whitening by a tiled covariance (operator 12).

Components become integers floor(256 * c). Means, covariance and components come from the fit list, each distinct vector
once. Its rows are centred and cut into row blocks of up to ROWS vectors and column blocks of TILE dimensions; the
column blocks are shuffled by row block, a task multiplies the pairs of column blocks of a row block (the pair is the
tile's key), and the products are summed for each tile. The driver assembles the tiles, whose number depends on the
dimensions alone, takes the eigenvectors, and sends them with the tasks that project every row. The whitened fit list's
own covariance is summed in one more pass: identity_error is measured, not derived.

Results defined for odd input: vectors that are null or hold null or non-finite entries are dropped, and so are empty
ones (no components), and those with entries whose integers aren't exact doubles (256 * |c| from 2^53 on). Vectors of
another dimension are fitted on their own, with their own n. Fewer dimensions than COMPONENTS give as many components. A
component without variance (rank below the number of components, such as one distinct vector only) has whitened null and
explained 0, and is left out of identity_error, which is null if none is left. A deviation that fits no long is null.
Repeated rows count once in the fit and are all returned; null and equal ids are rows of their own; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table

COMPONENTS, SCALE = 4, 256
#: Dimensions a column block, and vectors a row block.
TILE, ROWS = 16, 1024
#: Integers below this are exact doubles.
EXACT = 2.0**53
#: Eigenvalues up to this share of the trace, for each dimension, are rounding of 0.
NOTHING = 2.0**-50
#: Bits of the low half of an integer that is summed in two halves.
HALF = 26


def integers(vectors: DataFrame, vec_id: str, vec: str) -> DataFrame:
    """vec_id and x, the vector in integers, of the vectors that are kept."""
    whole = F.forall(vec, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < F.lit(EXACT), F.lit(False)))
    return vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0) & whole).select(F.col(vec_id).alias("vec_id"), F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x"))


def _by_dimension(batches):
    """Rows of one dimension, ROWS at most, with their vectors as a matrix of integers."""
    for batch in batches:
        lengths = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == dim)
            for k in range(0, len(mine), ROWS):
                rows = batch.take(pa.array(mine[k : k + ROWS]))
                yield dim, rows, rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each dimension the number of vectors and their exact sums; the driver gets two numbers for each dimension."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for dim, rows, x in _by_dimension(batches):
            halves = np.stack([x >> HALF, x & ((1 << HALF) - 1)]).sum(axis=1)
            total[dim] = total.get(dim, 0) + np.vstack([halves, np.full((1, dim), len(rows))])
        for dim, s in total.items():
            yield pa.record_batch([pa.array(np.full(s.size, dim, np.int32)), pa.array(np.arange(s.size, dtype=np.int32)), pa.array(s.ravel())], names=["dim", "at", "s"])

    flat: dict[int, list[int]] = {}
    for r in fit.mapInArrow(add, "dim int, at int, s long").groupBy("dim", "at").agg(F.sum("s").alias("s")).collect():
        flat.setdefault(r["dim"], [0] * 3 * r["dim"])[r["at"]] = r["s"]
    return {dim: (s[-1], [(s[k] << HALF) + s[dim + k] for k in range(dim)]) for dim, s in flat.items()}


def column_blocks(fit: DataFrame, means: dict[int, np.ndarray]) -> DataFrame:
    """dim, row_block, block, data: the centred rows of a row block, TILE dimensions of them, as doubles."""

    def cut(batches):
        number = TaskContext.get().partitionId() << 40
        for dim, _, x in _by_dimension(batches):
            y = x - means[dim]
            starts = range(0, dim, TILE)
            yield pa.record_batch([
                pa.array([dim] * len(starts), pa.int32()), pa.array([number] * len(starts), pa.int64()), pa.array([s // TILE for s in starts], pa.int32()),
                pa.array([np.ascontiguousarray(y[:, s : s + TILE]).tobytes() for s in starts], pa.binary()),
            ], names=["dim", "row_block", "block", "data"])
            number += 1

    return fit.mapInArrow(cut, "dim int, row_block long, block int, data binary")


def tiles(blocks: DataFrame) -> DataFrame:
    """dim, a, b, r and the sums s0, s1, ... of the products of dimension a * TILE + r with those of block b, a <= b."""
    columns = [f"s{k}" for k in range(TILE)]

    def multiply(key, table):
        dim = key[0].as_py()
        width = lambda b: min(TILE, dim - b * TILE)
        held = sorted((b, np.frombuffer(d, np.float64).reshape(-1, width(b))) for b, d in zip(table["block"].to_pylist(), table["data"].to_pylist(), strict=True))
        keys, products = [], []
        for i, (a, left) in enumerate(held):
            for b, right in held[i:]:
                product = np.zeros((len(left.T), TILE))
                product[:, : width(b)] = left.T @ right
                products.append(product)
                keys += [(a, b, r) for r in range(len(product))]
        s, at = np.vstack(products), np.array(keys, np.int32)
        return pa.table([pa.array(np.full(len(at), dim, np.int32)), *(pa.array(c.copy()) for c in at.T), *(pa.array(c.copy()) for c in s.T)], names=["dim", "a", "b", "r", *columns])

    schema = "dim int, a int, b int, r int, " + ", ".join(f"{c} double" for c in columns)
    products = blocks.groupBy("dim", "row_block").applyInArrow(multiply, schema)
    return products.groupBy("dim", "a", "b", "r").agg(*[F.sum(c).alias(c) for c in columns])


def covariance(summed: DataFrame, counts: dict[int, int]) -> dict[int, np.ndarray]:
    """The matrices, assembled from their tiles: as many numbers as half a matrix has."""
    out = {dim: np.zeros((dim, dim)) for dim in counts}
    for r in summed.collect():
        v, row, start = out[r["dim"]], r["a"] * TILE + r["r"], r["b"] * TILE
        stop = min(start + TILE, r["dim"])
        v[row, start:stop] = [r[f"s{k}"] for k in range(stop - start)]
        v[start:stop, row] = v[row, start:stop]
    return {dim: v / counts[dim] for dim, v in out.items()}


def axes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors as columns by falling eigenvalue, their eigenvalues, and these as shares of the trace; eigenvalues that are but rounding are 0."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:COMPONENTS]
    trace = float(np.trace(v))
    values = np.where(values[order] > trace * len(v) * NOTHING, values[order], 0.0)
    return vectors[:, order], values, values / trace if trace > 0 else values


def _scale(values: np.ndarray) -> np.ndarray:
    return np.where(values > 0, 1 / np.sqrt(np.where(values > 0, values, 1)), 0)


def identity_errors(fit: DataFrame, means: dict[int, np.ndarray], found: dict[int, tuple]) -> dict[int, float | None]:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, over components with variance."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for dim, _, x in _by_dimension(batches):
            vectors, values, _ = found[dim]
            w = np.hstack([((x - means[dim]) @ vectors) * _scale(values), np.ones((len(x), 1))])
            total[dim] = total.get(dim, 0) + w.T @ w
        for dim, s in total.items():
            yield pa.record_batch([pa.array(np.full(s.size, dim, np.int32)), pa.array(np.arange(s.size, dtype=np.int32)), pa.array(s.ravel())], names=["dim", "at", "s"])

    flat: dict[int, np.ndarray] = {}
    for r in fit.mapInArrow(add, "dim int, at int, s double").groupBy("dim", "at").agg(F.sum("s").alias("s")).collect():
        flat.setdefault(r["dim"], np.zeros((len(found[r["dim"]][1]) + 1) ** 2))[r["at"]] = r["s"]
    out: dict[int, float | None] = {}
    for dim, s in flat.items():
        side = len(found[dim][1]) + 1
        s = s.reshape(side, side)
        mean = s[-1, :-1] / s[-1, -1]
        off = np.abs(s[:-1, :-1] / s[-1, -1] - np.outer(mean, mean) - np.eye(side - 1))
        real = found[dim][1] > 0
        out[dim] = float(off[np.ix_(real, real)].max()) if real.any() else None
    return out


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Exact sums of (n * x - s) ^ 2 of each row; None beyond a long."""
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, s))
    if len(s) * reach * reach < 1 << 63:
        y = n * x - np.array(s, np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((n * c - t) ** 2 for c, t in zip(row, s, strict=True)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each kept vector and component."""
    kept = integers(vectors, vec_id, vec)
    fit = materialize(kept.select("x").distinct(), "whitening-fit")
    total = sums(fit)
    means = {dim: np.array([t / n for t in s]) for dim, (n, s) in total.items()}
    found = {dim: axes(v) for dim, v in covariance(tiles(column_blocks(fit, means)), {dim: n for dim, (n, _) in total.items()}).items()}
    errors = identity_errors(fit, means, found)
    id_type = kept.schema["vec_id"].dataType.simpleString()

    def project(batches):
        for dim, rows, x in _by_dimension(batches):
            vectors, values, explained = found[dim]
            n, s = total[dim]
            m = len(values)
            w = ((x - means[dim]) @ vectors) * _scale(values)
            each = pa.array(np.repeat(np.arange(len(rows)), m))
            yield pa.record_batch([
                rows.column("vec_id").take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(rows) * m, n, np.int64)),
                pa.array(deviations(x, n, s), pa.int64()).take(each), pa.array(w.ravel(), mask=np.tile(values <= 0, len(rows))), pa.array(np.tile(explained, len(rows))),
                pa.array([errors[dim]] * len(rows) * m, pa.float64()),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(project, f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_tiled_whitening(spark, sf_dir: str) -> DataFrame:
    # written: its tasks carry the eigenvectors, and tables that it was made from go
    return materialize(whiten(read_table(spark, sf_dir, "embeddings")), "whitened")
