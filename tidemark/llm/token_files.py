"""Token-ID / binary output: bit-plane shuffled blocks with a chunk index (operator 8).

File format (one file a shard, ``.bpl``), all numbers little-endian:

* ``BPL1``, then for each block of ``block_ids`` ids (the last may be shorter) its planes, each a zstandard
  frame: the ids as uint32 are transposed to byte planes (plane k holds byte k of every id) or bit planes
  (bit k of every id, packed); planes above the block's largest id are left out.
* a zstandard frame with the index: block offsets, ids a block, plane lengths, doc_ids, null flags, ids a document;
* the frame's offset and length as two uint64, and ``BPL1`` again.

Results defined for odd input: a null text is an empty document (only the end id); a null doc_id sorts first
and stays null; repeated doc_ids keep one entry a row, ordered by the text's hash; an empty table gives no
files and no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import json
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_type, fresh_path, materialize, read_table, text_bytes, text_slices
from .tokens import encoder

MAGIC = b"BPL1"
BLOCK_IDS = 1 << 16
#: Ids of a file, after which a partition goes on with another one; so a file, its index and what a writer holds are bounded.
FILE_IDS = 1 << 28
#: Bits of a file's number within its partition.
FILE_BITS = 20
SHARDS = "shard long, path string, n_docs long, n_ids long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """The planes of one block, lowest first."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if mode == "byte":
        return [np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, k]).tobytes() for k in range((top + 7) // 8)]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        out = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, np.uint8)
        return out.reshape(-1).view("<u4")
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


class ShardWriter:
    """Streams ids of consecutive documents into one file; it holds one block and the document index."""

    def __init__(self, sink, mode: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        import zstandard

        self.sink, self.mode, self.block_ids, self.zstd = sink, mode, block_ids, zstandard.ZstdCompressor(level=level)
        self.sink.write(MAGIC)
        self.at, self.blocks, self.held, self.n_held = len(MAGIC), [], [], 0
        self.doc_ids, self.nulls, self.counts = [], [], []

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_ids), self.nulls.append(nulls), self.counts.append(counts)
        self.held.append(ids.astype(np.uint32))
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            whole = np.concatenate(self.held)
            cut = len(whole) - len(whole) % self.block_ids
            for i in range(0, cut, self.block_ids):
                self._block(whole[i : i + self.block_ids])
            self.held, self.n_held = [whole[cut:]], len(whole) - cut

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) for p in to_planes(ids, self.mode)]
        self.blocks.append([self.at, len(ids), [len(p) for p in planes]])
        for p in planes:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> tuple[int, int]:
        if self.n_held:
            self._block(np.concatenate(self.held))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        counts = join(self.counts, "<i8")
        head = json.dumps({"mode": self.mode, "docs": len(counts), "blocks": self.blocks}).encode()
        index = self.zstd.compress(len(head).to_bytes(8, "little") + head + join(self.doc_ids, "<i8").tobytes() + join(self.nulls, "u1").tobytes() + counts.tobytes())
        self.sink.write(index + self.at.to_bytes(8, "little") + len(index).to_bytes(8, "little") + MAGIC)
        return len(counts), int(counts.sum())


class ShardReader:
    """Random access to a shard: the index at once, blocks when asked for."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size() if hasattr(source, "size") else source.seek(0, 2)
        source.seek(size - 20)
        tail = source.read(20)
        if tail[16:] != MAGIC:
            raise ValueError("not a token file, or one cut short")
        source.seek(int.from_bytes(tail[:8], "little"))
        raw = self.zstd.decompress(source.read(int.from_bytes(tail[8:16], "little")))
        cut = 8 + int.from_bytes(raw[:8], "little")
        head = json.loads(raw[8:cut])
        self.mode, self.blocks, n = head["mode"], head["blocks"], head["docs"]
        self.doc_ids = np.frombuffer(raw, "<i8", n, cut)
        self.nulls = np.frombuffer(raw, "u1", n, cut + 8 * n).astype(bool)
        self.counts = np.frombuffer(raw, "<i8", n, cut + 9 * n)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.block_starts = np.concatenate([[0], np.cumsum([b[1] for b in self.blocks])]).astype(np.int64)
        self._last: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint32))

    def block(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            at, n, sizes = self.blocks[k]
            self.source.seek(at)
            self._last = k, from_planes([self.zstd.decompress(self.source.read(s)) for s in sizes], n, self.mode)
        return self._last[1]

    def ids(self, doc: int) -> np.ndarray:
        """The ids of the shard's document number ``doc``; only its blocks are read."""
        start, stop = int(self.starts[doc]), int(self.starts[doc + 1])
        k, parts = int(np.searchsorted(self.block_starts, start, side="right")) - 1, []
        while start < stop:
            base = int(self.block_starts[k])
            take = self.block(k)[start - base : stop - base]
            parts.append(take)
            start, k = start + len(take), k + 1
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, mode: str = "byte", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write files of about ``file_ids`` ids in ascending doc_id order; one row a file, whose numbers ascend in that order.

    The text is range-partitioned by (doc_id, its hash), so a doc_id that many rows share still spreads. File
    names follow the partition and the place in it, content is fixed by the order, and a file appears by a rename: a
    task that runs again replaces its files by the same bytes.
    """

    def write(batches):
        task = TaskContext.get()
        enc, shard = encoder(tokenizer), task.partitionId() << FILE_BITS
        store, base = pafs.FileSystem.from_uri(folder)
        part = f"{base}/.{shard}.{task.taskAttemptId()}"
        writer = sink = None

        def close():
            n_docs, n_ids = writer.close()
            sink.close()
            name = f"{base}/{shard >> FILE_BITS:06d}-{shard & ((1 << FILE_BITS) - 1):06d}.bpl"
            store.move(part, name)
            return pa.RecordBatch.from_pylist([{"shard": shard, "path": name, "n_docs": n_docs, "n_ids": n_ids}], schema=arrow_type(SHARDS))

        written = 0
        for batch in batches:
            for piece in text_slices(batch, "text"):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(part)
                    writer = ShardWriter(sink, mode)
                flat, counts = enc.encode(*text_bytes(piece.column("text")))
                ids = np.insert(flat, np.cumsum(counts), end_id)
                doc = piece.column("doc_id")
                writer.add(doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False), counts + 1, ids)
                written += len(ids)
                if written >= file_ids:
                    yield close()
                    writer, written, shard = None, 0, shard + 1
        if writer is not None:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(rows.mapInArrow(write, SHARDS), "token-shards")


def read_token_files(shards: DataFrame, folder: str) -> DataFrame:
    """Read every document back: doc_id, start (ids of all documents before it), n_tokens and the crc32 of its ids."""

    def read(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as f:
                    reader = ShardReader(f)
                    if int(reader.starts[-1]) != row["n_ids"]:
                        raise ValueError(f"{row['path']} holds other ids than its shard row says")
                    for i in range(0, len(reader.counts), 4096):
                        span = range(i, min(i + 4096, len(reader.counts)))
                        crc = np.array([zlib.crc32(reader.ids(k).astype("<u4").tobytes()) for k in span], np.int64)
                        at = slice(span.start, span.stop)
                        yield pa.record_batch([pa.array(reader.doc_ids[at], mask=reader.nulls[at]), pa.array(reader.starts[:-1][at] + row["base"]), pa.array(reader.counts[at]), pa.array(crc)], schema=arrow_type(DOCS))

    n = shards.count()
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one short row a file
    based = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return based.repartitionByRange(max(1, n), "shard").mapInArrow(read, DOCS)


def shard_bytes(ids: list[list[int]], mode: str = "byte", block_ids: int = BLOCK_IDS) -> bytes:
    """A shard of given documents in memory (tests, small exports)."""
    out = io.BytesIO()
    w = ShardWriter(out, mode, block_ids)
    flat = np.array([i for d in ids for i in d], np.uint32)
    w.add(np.arange(len(ids)), np.zeros(len(ids), bool), np.array([len(d) for d in ids], np.int64), flat)
    w.close()
    return out.getvalue()


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "token-files", lasting=True)
    shards = write_token_files(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(shards, folder)
