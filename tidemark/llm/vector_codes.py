"""Vector code compression: product codes learnt by Elkan's form of Lloyd's rounds (operator 11).

Components become integers floor(256 * x), vectors are cut into PARTS equal parts, and each part position has a codebook
of up to ENTRIES entries, at first that part of the vectors with the smallest ids. A round assigns each part to its
nearest entry and moves every entry to the floored mean of its parts. Beside its code each part keeps an upper bound of
the distance to its entry and one lower bound for each entry. Between rounds bounds are shifted by how far the entries
moved; an entry is left out if the upper bound is strictly below its lower bound, or twice the upper bound strictly
below the distance of the two entries (triangle inequality). What is left is compared in integers, so ties, which go to
the lower index, are never decided by rounding: upper bounds are rounded up and lower bounds down, also when they are
stored (a byte each, with one step for a part). The rows with their bounds are a table in the shared folder, so a round
reads the last one's; the driver holds codebooks only, whose size doesn't depend on the rows.

Results defined for odd input: vectors that are null or hold null or non-finite components are dropped, and so are those
that can't be cut into equal parts, and those whose components are so large (about 32,000 for 64 dimensions) that
squared distances might not fit a long. Vectors of another dimension have codebooks of their own; empty vectors have
parts without components (code 0, error 0). With fewer vectors than entries the codebooks are as small. Repeated rows
and equal ids count as rows of their own (equal ids in the order of their vectors, null ids last); null labels are a
group of their own; a sum of errors that fits no long is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, read_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Twice a vector's largest length in integers stays below this, so that a squared distance times the number of entries fits 64 bits.
SPAN = 2.0**27
#: Rows that the kernel works on at once.
ROWS = 1024
#: Shares that the rows of a label are cut into when its sum is joined back.
SALTS = 16
_OUT = "vec_id long, label {label}, code string, error long, codebooks_sha256 string"


def integers(vectors: DataFrame, vec_id: str, vec: str, label: str) -> DataFrame:
    """vec_id, label and x, the vector in integers, of the vectors that are kept."""
    whole = F.forall(vec, lambda c: F.coalesce(F.abs(c.cast("double")) * F.lit(2.0 * SCALE) * F.sqrt(F.size(vec).cast("double")) < F.lit(SPAN), F.lit(False)))
    fits = F.col(vec).isNotNull() & (F.size(vec) % PARTS == 0) & whole
    return vectors.where(fits).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE).cast("int")).alias("x"))


def _up(squared: np.ndarray) -> np.ndarray:
    """Roots of exact squares, not below the true ones."""
    return np.nextafter(np.sqrt(squared.astype(np.float64)), np.inf) * (1 + 2.0**-50)


def _down(squared: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(squared.astype(np.float64)) * (1 - 2.0**-50), 0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def first_assignment(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, upper and lower bounds of parts that have none yet: every entry is compared."""
    squared = _squared(x[:, None, :], book[None])
    code = squared.argmin(axis=1)  # the first of equal ones
    return code, _up(squared[np.arange(len(x)), code]), _down(squared)


def next_assignment(x: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As first_assignment, by bounds that hold for ``book`` and the former ``code``; and how many distances were taken."""
    apart = _down(_squared(book[:, None, :], book[None]))
    code, upper, lower = code.copy(), upper.copy(), lower.copy()

    def open_pairs(rows):
        u = upper[rows, None]
        return (u >= lower[rows]) & (2 * u >= apart[code[rows]]) & (np.arange(len(book)) != code[rows, None])

    rows = np.flatnonzero(open_pairs(slice(None)).any(axis=1))
    own = _squared(x[rows], book[code[rows]])
    upper[rows] = _up(own)
    at, entry = np.nonzero(open_pairs(rows))
    squared = _squared(x[rows[at]], book[entry])
    lower[rows[at], entry] = _down(squared)
    lower[rows, code[rows]] = _down(own)
    best = own * len(book) + code[rows]  # the least distance, then the least index
    np.minimum.at(best, at, squared * len(book) + entry)
    code[rows] = best % len(book)
    upper[rows] = _up(best // len(book))
    return code, upper, lower, len(rows) + len(at)


def _blobs(a: np.ndarray) -> pa.Array:
    """One binary value a row of a two-dimensional array."""
    a = np.ascontiguousarray(a)
    ends = np.arange(len(a) + 1, dtype=np.int32) * np.int32(a.itemsize * a.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(a)])


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _by_dimension(batches):
    """Slices of at most ROWS rows of one dimension, with their vectors as (rows, PARTS, components)."""
    for batch in batches:
        lengths = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == dim)
            for k in range(0, len(mine), ROWS):
                rows = batch.take(pa.array(mine[k : k + ROWS]))
                yield dim, rows, rows.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), PARTS, dim // PARTS)


def _restore(rows, m: int, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stored codes and bounds, shifted by how far each entry moved: codes and upper (rows, PARTS), lower (rows, PARTS, m)."""
    code = _matrix(rows.column("codes"), "u1").astype(np.int64)
    upper, step = _matrix(rows.column("upper"), "<f4").astype(np.float64), _matrix(rows.column("step"), "<f4").astype(np.float64)
    lower = _matrix(rows.column("lower"), "u1").reshape(len(code), PARTS, m) * step[:, :, None] * (1 - 2.0**-50)
    part = np.arange(PARTS)
    return code, (upper + moved[part, code]) * (1 + 2.0**-50), np.maximum((lower - moved[None]) * (1 - 2.0**-50), 0)


def assign(table: DataFrame, books: dict[int, np.ndarray], moved: dict[int, np.ndarray] | None) -> DataFrame:
    """The rows with codes and bounds for ``books``, from rows with the bounds of the books before (``moved``: by how much), or without any."""

    def run(batches):
        for dim, rows, x in _by_dimension(batches):
            book = books[dim]
            m = book.shape[1]
            code, upper, lower = np.empty((len(rows), PARTS), np.int64), np.empty((len(rows), PARTS)), np.empty((len(rows), PARTS, m))
            before = None if moved is None else _restore(rows, m, moved[dim])
            for p in range(PARTS):
                if before is None:
                    code[:, p], upper[:, p], lower[:, p] = first_assignment(x[:, p], book[p])
                else:
                    code[:, p], upper[:, p], lower[:, p], _ = next_assignment(x[:, p], book[p], before[0][:, p], before[1][:, p], before[2][:, p])
            step = np.nextafter((lower.max(axis=2) / 255).astype("<f4"), np.float32(np.inf))
            stored = np.minimum(np.floor(lower / step[:, :, None].astype(np.float64)), 255).astype("u1")
            high = np.nextafter(upper.astype("<f4"), np.float32(np.inf))
            yield pa.record_batch(
                [rows.column("vec_id"), rows.column("label"), rows.column("x"), _blobs(code.astype("u1")), _blobs(high), _blobs(step), _blobs(stored.reshape(len(rows), -1))],
                names=["vec_id", "label", "x", "codes", "upper", "step", "lower"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema if f.name in ("vec_id", "label", "x"))
    return table.mapInArrow(run, f"{kinds}, codes binary, upper binary, step binary, lower binary")


def means(table: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Each entry's floored mean of the parts that have it; entries without parts stay."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for dim, rows, x in _by_dimension(batches):
            code = _matrix(rows.column("codes"), "u1").astype(np.int64)
            s = total.setdefault(dim, np.zeros((*books[dim].shape[:2], dim // PARTS + 1), np.int64))
            one = np.ones((len(rows), 1), np.int64)
            for p in range(PARTS):
                np.add.at(s[p], code[:, p], np.hstack([x[:, p], one]))
        for dim, s in total.items():
            yield pa.record_batch([pa.array(np.full(s.size, dim, np.int32)), pa.array(np.arange(s.size, dtype=np.int32)), pa.array(s.ravel())], names=["dim", "at", "s"])

    out = {dim: np.zeros(b.shape[0] * b.shape[1] * (b.shape[2] + 1), np.int64) for dim, b in books.items()}
    # as many rows as the codebooks have components and entries
    for r in table.select("x", "codes").mapInArrow(sums, "dim int, at int, s long").groupBy("dim", "at").agg(F.sum("s").alias("s")).collect():
        out[r["dim"]][r["at"]] = r["s"]
    for dim, flat in out.items():
        b = books[dim]
        s = flat.reshape(*b.shape[:2], -1)
        out[dim] = np.where(s[..., -1:] > 0, s[..., :-1] // np.maximum(s[..., -1:], 1), b)
    return out


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label") -> tuple[DataFrame, dict[int, np.ndarray]]:
    """vec_id, label, code, error and codebooks_sha256 of each kept vector, and the codebooks by dimension, as (parts, entries, components)."""
    table = materialize(integers(vectors, vec_id, vec, label), "code-rows")
    books: dict[int, np.ndarray] = {}
    for dim in [r[0] for r in table.select(F.size("x")).distinct().collect()]:  # dimensions are few
        # ENTRIES rows
        first = table.where(F.size("x") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(ENTRIES).collect()
        books[dim] = np.array([r["x"] for r in first], np.int64).reshape(len(first), PARTS, dim // PARTS).transpose(1, 0, 2).copy()
    moved = None
    for k in range(ROUNDS):
        done = materialize(assign(table, books, moved), f"code-round-{k}")
        new = means(done, books)
        moved = {dim: _up(_squared(new[dim], books[dim])) for dim in books}
        drop_table(table)
        table, books = done, new
    hashes = {dim: digest(book) for dim, book in books.items()}

    def last(batches):
        for batch in batches:
            rows = pa.record_batch([batch.column(c) for c in ("vec_id", "label", "x", "codes")], names=["vec_id", "label", "x", "codes"])
            for dim, part, x in _by_dimension([rows]):
                code = _matrix(part.column("codes"), "u1")
                error = sum(_squared(x[:, p], books[dim][p][code[:, p]]) for p in range(PARTS))
                yield pa.record_batch(
                    [part.column("vec_id"), part.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error), pa.array([hashes[dim]] * len(part), pa.string())],
                    names=["vec_id", "label", "code", "error", "codebooks_sha256"],
                )

    out = assign(table, books, moved).mapInArrow(last, _OUT.format(label=table.schema["label"].dataType.simpleString()).replace("vec_id long", f"vec_id {table.schema['vec_id'].dataType.simpleString()}"))
    return out, books


def label_errors(coded: DataFrame) -> DataFrame:
    """Rows with label_error, the summed error of their label; a label's rows are spread over SALTS keys, as one may have a third of all."""
    sums = materialize(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "code-labels", rows=1)
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("label", "other")
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, (dealt["salt"] == salted["salt"]) & dealt["label"].eqNullSafe(salted["other"]), "left").drop("salt", "other")


def op11_elkan_codes(spark, sf_dir: str) -> DataFrame:
    coded = materialize(compress(read_table(spark, sf_dir, "embeddings"))[0], "codes")
    return label_errors(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """Plain Lloyd rounds: every part against every entry."""
    steps = ["""
kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS (SELECT vec_id, label, p, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS v FROM kept, range(16) r(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY e < 64)"""]  # fmt: skip
    for k in range(ROUNDS + 1):
        steps.append(f"""
d{k} AS (
  SELECT vec_id, label, parts.p, parts.v, e, list_sum(list_transform(list_zip(parts.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM parts JOIN b{k} b USING (p)),
a{k} AS (SELECT vec_id, any_value(label) AS label, p, any_value(v) AS v, min({{'d': d, 'e': e}}) AS best FROM d{k} GROUP BY vec_id, p)""")
        if k < ROUNDS:
            steps.append(f"""
m{k} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (
    SELECT p, best.e AS e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM (SELECT p, best, v, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY p, e),
b{k + 1} AS (SELECT p, e, coalesce(m{k}.v, b{k}.v) AS v FROM b{k} LEFT JOIN m{k} USING (p, e))""")
    steps.append(f"""
s AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM s, h""")
    return "WITH " + ",".join(steps)


ORACLE = _oracle()
