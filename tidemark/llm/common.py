"""Shared plumbing: intermediate tables in the shared folder, row slices and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import discard, note_made, tidy

#: Text bytes that a kernel holds at once; a single longer document is a slice of its own.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a local session (tests) gets one of its own; on a cluster that is an error, for executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str, lasting: bool = False) -> str:
    """A new path in the shared folder. ``lasting``: it is for files that are results (archives, token files), which tidy() leaves alone."""
    path = f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    return path if lasting else note_made(path)


#: Rows of a narrow table that a file holds at least, and files that such a table is spread over in any case.
FILE_ROWS, LEAST_FILES = 500_000, 8


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    ``rows``: about how many narrow rows there are; the table gets files for that many instead of one a shuffle partition.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, rows // FILE_ROWS))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by materialize() that nothing reads any more."""
    discard(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns; together a key that doesn't collide in practice."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a batch into slices of at most ``limit`` text bytes (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array in one buffer, and n + 1 offsets into it; null counts as empty."""
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(array) else np.empty(0, np.uint8)
    return data, (offsets - offsets[0] if len(array) else np.zeros(1, np.int64))


def texts(array: pa.Array) -> list[bytes]:
    return pc.fill_null(array.cast(pa.large_binary()), b"").to_pylist()


def ragged_take(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``index`` of a ragged array, joined, and their lengths."""
    lengths = offsets[index + 1] - offsets[index]
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0], lengths
    shift = np.repeat(offsets[index] - (ends - lengths), lengths)
    return flat[np.arange(ends[-1]) + shift], lengths


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}


def arrow_type(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string, without a session (workers have none)."""

    def of(name: str) -> pa.DataType:
        return pa.list_(of(name[6:-1])) if name.startswith("array<") else _TYPES[name]

    return pa.schema([(name, of(kind)) for name, kind in (column.split() for column in ddl.split(", "))])
