"""Best-fit packing: best-two-fit over the histogram of piece lengths (operator 10).

Only how many pieces have each length decides a packing, so the plan is made from that histogram (at most
``capacity`` entries, whatever the corpus) and is the same as packing all pieces at once. Pieces then get their
places by their rank among the pieces of their length, which Spark computes by bucket.

Results defined for odd input: a null text is an empty document (one piece: the end id); null and repeated
doc_ids are kept, one set of pieces a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_type, materialize, read_table, text_bytes, text_slices
from .tokens import encoder

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that share a length and a bucket are ranked in one task.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 32


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (times used, [(length, copies), ...]) that hold every piece of the histogram.

    Each bin is filled greedily, the longest unpacked piece that fits first. If a gap stays, its smallest piece
    gives way to the two unpacked pieces that fill the expanded gap best, if they fill it better than before.
    A bin that can be built again from what is left is built as often as that goes.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} fits no bin of {capacity}")
        left[length] += n
    plan = []
    lengths = np.flatnonzero(left)
    while len(lengths):
        used: Counter[int] = Counter()
        gap, free = capacity, left.copy()
        while gap:
            k = int(np.searchsorted(lengths, gap, side="right")) - 1
            while k >= 0 and not free[lengths[k]]:
                k -= 1
            if k < 0:
                break
            length = int(lengths[k])
            n = min(gap // length, int(free[length]))
            used[length] += n
            free[length] -= n
            gap -= n * length
        if gap:
            small = min(used)
            room = gap + small
            have = lengths[(lengths <= room) & (free[lengths] > 0)]
            if len(have):
                at = np.searchsorted(have, room - have, side="right") - 1
                other = have[np.maximum(at, 0)]
                lone = (other == have) & (free[have] < 2)  # only one of that length: take the next shorter
                other = np.where(lone & (at > 0), have[np.maximum(at - 1, 0)], other)
                total = np.where((at >= 0) & ~(lone & (at == 0)), have + other, 0)
                best = int(np.argmax(total))
                if total[best] > small:
                    used[small] -= 1
                    used += Counter([int(have[best]), int(other[best])])  # also drops a count of zero
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= times * n
        plan.append((times, sorted(used.items(), reverse=True)))
        lengths = lengths[left[lengths] > 0]
    return plan


class Places:
    """From (length, rank among the pieces of that length) to (sequence, offset)."""

    def __init__(self, plan: list[tuple[int, list[tuple[int, int]]]]):
        rows, ranks, sequence = [], Counter(), 0
        for times, content in plan:
            offset = 0
            for length, n in content:
                rows.append(((length << 48) + ranks[length], sequence, n, offset))
                ranks[length] += times * n
                offset += length * n
            sequence += times
        self.sequences = sequence
        self.keys, self.sequence, self.copies, self.offset = (np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.empty(0, np.int64),) * 4

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 48) + rank
        at = np.searchsorted(self.keys, key, side="right") - 1
        turn = key - self.keys[at]
        return self.sequence[at] + turn // self.copies[at], self.offset[at] + turn % self.copies[at] * length


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Encode each text, add the end id and cut what is longer than ``capacity``."""

    def cut(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part in text_slices(batch, "text"):
                flat, counts = enc.encode(*text_bytes(part.column("text")))
                ids = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(counts[row] - start, capacity)
                at = (np.cumsum(counts) - counts)[row] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.record_batch([part.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], schema=arrow_type(PIECES))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pack ``docs`` (doc_id, text): one row a piece with its sequence_id and offset."""
    pieces = materialize(cut_pieces(docs, tokenizer, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    places = Places(plan_bins(histogram, capacity))
    buckets = max(LEAST_BUCKETS, -(-sum(histogram.values()) // BUCKET_ROWS))
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int"))
    counts = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("uid")
    ranked = spread.join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)

    out = f"{PIECES}, sequence_id long, offset long"

    def place(batches):
        for b in batches:
            sequence, offset = places.of(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.record_batch([*b.columns[:5], pa.array(sequence), pa.array(offset)], schema=arrow_type(out))

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, out)


def op10_best_two_fit(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
