"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles (operator 7).

Shingles are five lower-cased words (all words of a shorter text); a shingle weighs tf * (1 + LAMBDA * ln(N / df) / ln N),
with df over all N documents. Consistent weighted sampling draws K samples a document, banded to BANDS keys.
Documents that share a key meet; by their samples they are linked to leaders, loosely, which gives candidate
clusters; within a cluster the weighted Jaccard similarity decides, exactly, and the classes are the connected
components of pairs at or over SIMILARITY. Nothing emits all pairs of a group, and no group is cut short:

* equal texts are one class before anything else;
* documents of a key beyond ``SUB_BUCKET`` meet in parts, other ones for each key. Where that leaves the leaders of a
  key in several candidate clusters, all pairs of parts of its leaders meet again, with a limit lowered by what a
  document and the leader that covers it may differ;
* a candidate cluster of any size is compared in blocks of bounded rows and shingles with a bounded set of pivots.
  Pivots then know all their links. Rounds go on until all documents that were no pivot are in one class, so no link
  between classes is lost.

Document frequencies don't need a row a shingle: texts are packed to batches, each batch sends its sorted, distinct
shingles by hash range (differences, packed planes), and gets one byte a shingle back, the frequency on a
logarithmic scale, in the same order.

Results defined for odd input: a null text is a class of its own, each row; equal texts (also empty ones) are one
class; the kept row of a class has the smallest doc_id, and of rows with that doc_id one of them; null doc_ids
come after all others; an empty table gives no rows; the columns of ``docs`` come back in a struct, so that no name of theirs can clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import arrow_type, drop_table, fingerprint, materialize, ragged_take, read_table, text_bytes, text_slices
from .epsilon_grid import forest
from .graph import components
from .textops import pack_keys, unpack_keys

SHINGLE, SIMILARITY, LAMBDA = 5, 0.8, 0.25
BANDS, ROWS = 14, 4
K = BANDS * ROWS
#: Of K samples so many agree at least where two documents may be linked; and where one stands for the other.
LINK, COVER = round(0.43 * K), round(0.85 * K)
#: ... where two leaders are linked that cover documents of their parts: these may be 0.8 alike while their leaders are only 0.5 alike.
LINK_LEADERS = round(0.3 * K)
SUB_BUCKET = 1024
BATCH_BYTES = 4 << 20
#: Shingles a hash range, and the bits by which a range tells its shingles apart.
RANGE_SHINGLES, RANGE_BITS = 1 << 22, 36
#: Shingles and rows a block of a candidate cluster, and those of its pivots in one round.
BLOCK_SHINGLES, PIVOT_SHINGLES = 400_000, 100_000
BLOCK_ROWS, PIVOT_ROWS = 1024, 512
#: Shingles that are sampled together.
IN_CACHE = 1 << 15
_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle keys of ``bits`` bits of each document, joined, and n + 1 offsets; text is lower-cased already."""
    starts, stops, first = textops.words(data, offsets)
    h = textops.hash_spans(data, starts, stops)
    keys, at = textops.windows(h, first, SHINGLE)
    count = np.diff(first)
    sizes = np.maximum(count - SHINGLE + 1, 0)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        whole = np.array([_U(0)] * len(short))
        for j in range(SHINGLE - 1):
            has = count[short] > j
            whole[has] = textops.mix(whole[has] * _U(31) + h[first[short[has]] + j])
        keys = np.insert(keys, (np.cumsum(sizes) - sizes)[short], whole)
        sizes[short] = 1
    return textops.mix(keys) >> _U(64 - bits), np.concatenate([[0], np.cumsum(sizes)])


def code_of(df: np.ndarray) -> np.ndarray:
    """Document frequencies on a scale of eighths of a power of two."""
    return np.minimum(np.round(8 * np.log2(df)), 255).astype(np.uint8)


def idf(code: np.ndarray, n_docs: int) -> np.ndarray:
    total = np.log(max(n_docs, 2))
    return 1 + LAMBDA * np.maximum(total - code * (np.log(2) / 8), 0) / total


class Sampler:
    """Consistent samples: the same shingle of the same weight draws the same numbers everywhere."""

    def __init__(self):
        p = (np.arange(1 << 16) + 0.5) / (1 << 16)
        g = np.linspace(0, 40, 1 << 20)
        self.gamma = np.interp(p, 1 - np.exp(-g) * (1 + g), g).astype(np.float32)  # quantiles of Gamma(2, 1)
        self.log_gamma = np.log(self.gamma)
        self.odd = textops.mix(np.arange(1, K + 1, dtype=np.uint64)) | _U(1)

    def draw(self, keys: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """K 32-bit samples of each document with shingles; ``offsets`` bound documents, none empty."""
        out = np.empty((len(offsets) - 1, K), np.uint32)
        h, log_w = textops.mix(keys), np.log(weights).astype(np.float32)
        first = 0
        while first < len(offsets) - 1:  # some documents at a time, so that all arrays stay in the cache
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + IN_CACHE, side="right")) - 1)
            a, b = int(offsets[first]), int(offsets[last])
            self._draw(h[a:b], keys[a:b], log_w[a:b], offsets[first : last + 1] - a, out[first:last])
            first = last
        return out

    def _draw(self, h: np.ndarray, keys: np.ndarray, log_w: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
        sizes, starts = np.diff(offsets), offsets[:-1]
        u, shifted = np.empty_like(h), np.empty_like(h)
        for k in range(K):
            np.multiply(h, self.odd[k], out=u)
            u ^= np.right_shift(u, _U(29), out=shifted)
            u *= _U(0xBF58476D1CE4E5B9)
            u ^= np.right_shift(u, _U(32), out=shifted)
            low = u.view("<u2").reshape(-1, 4)
            r, c = self.gamma[low[:, 0]], self.log_gamma[low[:, 1]]
            beta = u.view("<u4")[1::2].astype(np.float32)
            beta *= np.float32(2**-32)
            t = log_w / r
            t += beta
            np.floor(t, out=t)
            log_a = t - beta
            log_a += np.float32(1)
            log_a *= r
            np.subtract(c, log_a, out=log_a)
            least = np.minimum.reduceat(log_a, starts)
            at = np.flatnonzero(log_a == np.repeat(least, sizes))
            if len(at) > len(sizes):  # equal draws: the first
                at = at[np.unique(np.searchsorted(offsets, at, side="right"), return_index=True)[1]]
            out[:, k] = (textops.mix(keys[at] ^ (t[at].astype(np.int64).astype(np.uint64) * _U(0xBF58476D1CE4E5B9))) >> _U(32)).astype(np.uint32)


_sampler: list[Sampler] = []


def _batches(docs: DataFrame) -> DataFrame:
    """Texts packed to batches: one row holds some megabytes, compressed, with the documents' keys."""
    out = "batch long, n_docs int, n_words long, ids binary, t1 binary, t2 binary, ends binary, text binary"

    def run(parts):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        held: list = []
        size = 0

        def send():
            whole = pa.concat_batches(held) if hasattr(pa, "concat_batches") else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            data, offsets = text_bytes(whole.column("lower"))
            _, _, first = textops.words(data, offsets)
            raw = lambda c: whole.column(c).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
            return pa.RecordBatch.from_pylist([{"batch": 0, "n_docs": whole.num_rows, "n_words": int(first[-1]), "ids": raw("d"), "t1": raw("t1"), "t2": raw("t2"), "ends": offsets.astype("<i8").tobytes(), "text": squeeze.compress(data.tobytes())}], schema=arrow_type(out))

        for batch in parts:
            for part in text_slices(batch, "text", BATCH_BYTES):
                held.append(pa.record_batch([part.column("d"), part.column("t1"), part.column("t2"), pc.utf8_lower(part.column("text"))], names=["d", "t1", "t2", "lower"]))
                size += part.column("text").nbytes
                if size >= BATCH_BYTES:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    return materialize(docs.mapInArrow(run, out).withColumn("batch", F.monotonically_increasing_id()), "text-batches")


def _open(row: dict, bits: int) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
    return shingles(data, np.frombuffer(row["ends"], "<i8"), bits)


def _per_document(keys: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each document in order, their counts, and new offsets."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets))
    if n.bit_length() + bits <= 64:  # document and key in one number: one plain sort
        both = np.sort(owner << _U(bits) | keys)
        k, o = both & _U((1 << bits) - 1), (both >> _U(bits)).astype(np.int64)
    else:
        order = np.lexsort((keys, owner))
        k, o = keys[order], owner[order].astype(np.int64)
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return k[at], np.diff(np.append(at, len(k))), np.searchsorted(o[at], np.arange(n + 1))


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def coded_batches(packed: DataFrame, ranges: int, bits: int) -> DataFrame:
    """``packed`` with ``codes``: the document frequency of each distinct shingle of the batch, ascending by key."""
    sent = "range int, batch long, n int, keys binary, counts binary"

    def send(batches):
        for row in _rows(batches):
            keys, offsets = _open(row, bits)
            keys, _, _ = _per_document(keys, offsets, bits)
            u, n = np.unique(keys, return_counts=True)
            cut = np.searchsorted(u >> _U(RANGE_BITS), np.arange(ranges + 1, dtype=np.uint64))
            got = [(r, row["batch"], b - a, pack_keys(u[a:b] & _U((1 << RANGE_BITS) - 1)), zlib.compress(n[a:b].astype("<u4").tobytes(), 1)) for r, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*got, strict=True), arrow_type(sent).types, strict=True)] if got else [pa.array([], t) for t in arrow_type(sent).types], schema=arrow_type(sent))

    back = "batch long, range int, codes binary"

    def count(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        keys = np.concatenate([unpack_keys(x.as_py(), n) for x, n in zip(table.column("keys"), sizes.tolist(), strict=True)])
        counts = np.concatenate([np.frombuffer(zlib.decompress(x.as_py()), "<u4") for x in table.column("counts")])
        _, at = np.unique(keys, return_inverse=True)
        codes = code_of(np.bincount(at, weights=counts))[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        blobs = [zlib.compress(codes[a:b].tobytes(), 1) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return pa.table([table.column("batch").cast(pa.int64()), table.column("range").cast(pa.int32()), pa.array(blobs, pa.binary())], schema=arrow_type(back))

    codes = packed.mapInArrow(send, sent).groupBy("range").applyInArrow(count, back)
    sent_back = materialize(codes, "codes")
    codes = sent_back.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("range", "codes"))).alias("codes"))
    coded = materialize(packed.join(codes.select("batch", F.col("codes.codes").alias("codes")), "batch", "left"), "coded-batches")
    drop_table(packed), drop_table(sent_back)
    return coded


def _weighted(row: dict, bits: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each document (or of some), their counts and frequency codes, and offsets."""
    keys, offsets = _open(row, bits)
    every = np.sort(keys)
    every = every[np.append(True, every[1:] != every[:-1])] if len(every) else every
    if only is not None:
        keys, sizes = ragged_take(keys, offsets, only)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
    keys, tf, offsets = _per_document(keys, offsets, bits)
    codes = np.frombuffer(b"".join(zlib.decompress(c) for c in row["codes"] or []), np.uint8)
    return keys, tf, codes[np.searchsorted(every, keys)] if len(keys) else codes[:0], offsets


def sample_documents(coded: DataFrame, n_docs: int, bits: int) -> DataFrame:
    """(d, t1, t2, batch, at, n, bands, samples) of each document; bands are null without words."""
    out = "d long, t1 long, t2 long, batch long, at int, n int, bands array<long>, samples binary"

    def run(batches):
        if not _sampler:
            _sampler.append(Sampler())
        for row in _rows(batches):
            keys, tf, codes, offsets = _weighted(row, bits)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            bands: list = [None] * len(n)
            samples: list = [None] * len(n)
            if len(full):
                got = _sampler[0].draw(keys, tf * idf(codes, n_docs), np.append(offsets[:-1][full], len(keys)))
                h = np.zeros((len(full), BANDS), np.uint64)
                for j in range(ROWS):
                    h = textops.mix(h * _U(31) + got[:, j::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64) * _U(j == 0))
                for i, b, s in zip(full.tolist(), h.view(np.int64).tolist(), got.astype("<u2"), strict=True):
                    bands[i], samples[i] = b, s.tobytes()
            ids = [np.frombuffer(row[c], "<i8") for c in ("ids", "t1", "t2")]
            yield pa.record_batch([*map(pa.array, ids), pa.array(np.full(len(n), row["batch"])), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n.astype(np.int32)), pa.array(bands, pa.list_(pa.int64())), pa.array(samples, pa.binary())], schema=arrow_type(out))

    return coded.mapInArrow(run, out)


def _groups(batches, keys: list[str]):
    """Consecutive rows of equal keys, as lists of dicts, one group at a time."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def leader_links(met: DataFrame) -> DataFrame:
    """Rows (key, a, b, samples) for ``met`` (key, part, cid, samples): edges that connect all whom links leader - member connect, and with b null each leader.

    A leader is linked with all that agree with it in LINK samples. Whoever agrees with it in COVER samples needs
    no links of its own: what is similar to him agrees with his leader, too (the distance is a metric).
    """
    out = "key long, a long, b long, samples binary"

    def run(batches):
        for rows in _groups(batches, ["key", "part"]):
            cids = np.array([r["cid"] for r in rows])
            s = np.stack([np.frombuffer(r["samples"], "<u2") for r in rows])
            open_ = np.ones(len(rows), bool)
            p, q, leaders = [], [], []
            for i in range(len(rows)):
                if not open_[i]:
                    continue
                agree = (s == s[i]).sum(axis=1)
                open_[agree >= COVER] = False
                linked = np.flatnonzero((agree >= LINK) & (cids != cids[i]))
                p.append(np.full(len(linked), i)), q.append(linked), leaders.append(i)
            # only what is connected matters here: a spanning forest, not a link for each leader and member
            a, b = forest(np.concatenate(p), np.concatenate(q), len(rows))
            a, b = cids[a], cids[b]
            key = rows[0]["key"]
            yield pa.record_batch([pa.array(np.full(len(a) + len(leaders), key)), pa.array(np.concatenate([a, cids[leaders]])), pa.array(np.concatenate([b, np.zeros(len(leaders), np.int64)]), mask=np.arange(len(a) + len(leaders)) >= len(a)), pa.array([None] * len(a) + [s[i].tobytes() for i in leaders], pa.binary())], schema=arrow_type(out))

    return met.select("key", "part", "cid", "samples").repartition("key", "part").sortWithinPartitions("key", "part", "cid").mapInArrow(run, out)


def links_of_parts(met: DataFrame) -> DataFrame:
    """(a, b) for leaders ``met`` (key, part, parts, cid, root, samples): a spanning forest of the links between those of different roots, for all pairs of parts of a key."""
    out = "a long, b long"

    def run(batches):
        for rows in _groups(batches, ["key", "lo", "hi"]):
            cids, roots, part = (np.array([r[c] for r in rows]) for c in ("cid", "root", "part"))
            s = np.stack([np.frombuffer(r["samples"], "<u2") for r in rows])
            p, q = [], []
            inner = rows[0]["lo"] == rows[0]["hi"]
            for i in range(len(rows)):
                others = (roots != roots[i]) & ((np.arange(len(rows)) > i) if inner else (part > part[i]))
                linked = np.flatnonzero(others & ((s == s[i]).sum(axis=1) >= LINK_LEADERS))
                p.append(np.full(len(linked), i)), q.append(linked)
            a, b = forest(np.concatenate(p), np.concatenate(q), len(rows))
            yield pa.record_batch([pa.array(cids[a]), pa.array(cids[b])], schema=arrow_type(out))

    pairs = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    return pairs.select("key", "lo", "hi", "part", "cid", "root", "samples").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "cid").mapInArrow(run, out)


def candidate_clusters(classes: DataFrame) -> DataFrame:
    """(cid, cluster) of the classes that a link joins with another."""
    n_classes = classes.count()
    keys = classes.where("bands IS NOT NULL").select("cid", F.explode("bands").alias("key"))
    counts = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes", n_classes)
    parts = lambda n: F.ceil(n / SUB_BUCKET).cast("long")
    part = lambda n: F.pmod(F.xxhash64("cid", "key"), parts(n))
    met = materialize(keys.join(counts, "key").select("cid", "key", part(F.col("n")).alias("part")), "bucket-members", BANDS * n_classes)
    first = materialize(leader_links(met.join(classes.select("cid", "samples"), "cid")), "leader-links")
    found = materialize(components(first.where("b IS NOT NULL").select("a", "b").distinct()), "candidates")
    split = counts.where(F.col("n") > SUB_BUCKET).select("key")
    if split.isEmpty():
        return found
    leaders = first.where("b IS NULL").select("key", F.col("a").alias("cid"), "samples").join(split, "key")
    leaders = materialize(leaders.join(found.toDF("cid", "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid")), "leaders")
    apart = leaders.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key", "n")
    again = links_of_parts(leaders.join(apart, "key").select("key", part(F.col("n")).alias("part"), parts(F.col("n")).alias("parts"), "cid", "root", "samples"))
    return components(found.select(F.col("root").alias("a"), F.col("v").alias("b")).unionByName(again))


def _vectors(coded: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """(cid, cluster, n, keys, tf, codes) for ``wanted`` (batch, at, cid, cluster)."""
    out = "cid long, cluster long, n long, keys binary, tf binary, codes binary"

    def run(batches):
        for row in _rows(batches):
            keys, tf, codes, offsets = _weighted(row, bits, np.array([w["at"] for w in row["wanted"]], np.int64))
            got = []
            for w, a, b in zip(row["wanted"], offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                got.append((w["cid"], w["cluster"], int(tf[a:b].sum()), pack_keys(keys[a:b]), zlib.compress(tf[a:b].astype("<u4").tobytes(), 1), zlib.compress(codes[a:b].tobytes(), 1)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*got, strict=True), arrow_type(out).types, strict=True)], schema=arrow_type(out))

    grouped = wanted.groupBy("batch").agg(F.collect_list(F.struct("at", "cid", "cluster")).alias("wanted"))
    return materialize(coded.join(grouped, "batch").mapInArrow(run, out), "vectors")


def similar_pairs(blocks: DataFrame, n_docs: int, similarity: float) -> DataFrame:
    """(a, b) that connect all classes of each block linked with its pivots at ``similarity`` or more."""
    out = "a long, b long"

    def run(batches):
        for rows in _groups(batches, ["cluster", "block"]):
            yield from compare(rows)

    def compare(rows):
        rows = list({(r["cid"], r["pivot"]): r for r in rows}.values())
        pivots = [r for r in rows if r["pivot"]]
        others = [r for r in rows if not r["pivot"]]
        rows = pivots + others
        if not pivots or len(rows) < 2:
            return
        feature, weight, owner = [], [], []
        for i, r in enumerate(rows):
            tf = np.frombuffer(zlib.decompress(r["tf"]), "<u4")
            keys = unpack_keys(r["keys"], len(tf))
            w = idf(np.frombuffer(zlib.decompress(r["codes"]), np.uint8), n_docs)
            turn = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)  # min(tf, tf') counts the turns both have
            feature.append(textops.mix(np.repeat(keys, tf) * _U(0x9E3779B97F4A7C15) + turn.astype(np.uint64)))
            weight.append(np.repeat(w, tf))
            owner.append(np.full(len(turn), i))
        total = np.array([w.sum() for w in weight])
        feature, weight, owner = (np.concatenate(x) for x in (feature, weight, owner))
        _, first, at, n = np.unique(feature, return_index=True, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(n > 1)
        column = np.full(len(n), -1)
        column[shared] = np.arange(len(shared))
        column, value = column[at], np.sqrt(weight[first[shared]])
        both = np.zeros((len(pivots), len(rows)))
        order = np.argsort(column, kind="stable")
        order = order[np.searchsorted(column[order], 0) :]
        for lo in range(0, len(shared), 2048):
            part = order[np.searchsorted(column[order], lo) : np.searchsorted(column[order], lo + 2048)]
            x = np.zeros((len(rows), min(2048, len(shared) - lo)))
            x[owner[part], column[part] - lo] = value[column[part]]
            both += x[: len(pivots)] @ x.T
        union = total[: len(pivots), None] + total[None, :] - both
        p, q = np.nonzero(both >= (similarity - 1e-9) * union)
        cids = np.array([r["cid"] for r in rows])
        p, q = p[cids[p] != cids[q]], q[cids[p] != cids[q]]
        _, same = np.unique(cids, return_inverse=True)  # a pivot also stands among the others of its own block
        a, b = forest(same[p], same[q], int(same.max()) + 1)
        names = np.unique(cids)
        yield pa.record_batch([pa.array(names[a]), pa.array(names[b])], schema=arrow_type(out))

    return blocks.repartition("cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(run, out)


def verified_classes(vectors: DataFrame, n_docs: int, similarity: float) -> DataFrame:
    """(v, root) of the classes linked at ``similarity`` or more."""
    state = materialize(vectors.select("cid", "cluster", "n", F.col("cid").alias("label"), F.lit(True).alias("todo"), F.lit(True).alias("may")), "cluster-state")
    rows = state.count()
    turn = 0
    while True:
        open_ = state.where("todo").groupBy("cluster").agg(F.sum(F.when(F.col("may"), F.col("n"))).alias("eligible"), F.count(F.when(F.col("may"), 1)).alias("eligible_rows"))
        sizes = state.groupBy("cluster").agg(F.sum("n").alias("size"), F.count("*").alias("members")).join(open_.where("eligible > 0"), "cluster")
        sizes = materialize(sizes, "cluster-sizes", rows)
        if sizes.isEmpty():
            break
        blocks = F.ceil(F.greatest(F.col("size") / BLOCK_SHINGLES, F.col("members") / BLOCK_ROWS))
        draw = F.pmod(F.xxhash64("cid", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        live = materialize(state.join(sizes, "cluster").select("cid", "cluster", "todo", "may", blocks.alias("blocks"), (F.col("todo") & F.col("may") & (draw * F.col("eligible") < PIVOT_SHINGLES) & (draw * F.col("eligible_rows") < PIVOT_ROWS)).alias("pivot")), "cluster-live", rows)
        body = live.join(vectors.drop("cluster"), "cid")
        spread = body.where("pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).unionByName(body.where("NOT pivot OR blocks > 1").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks"))).withColumn("pivot", F.lit(False)))
        found = materialize(similar_pairs(spread.select("cluster", F.col("block").cast("long").alias("block"), "cid", "pivot", "keys", "tf", "codes"), n_docs, similarity), "similar")
        # what is linked so far is in the labels: a label's members needn't be joined again
        known = state.where("cid <> label").select(F.col("label").alias("a"), F.col("cid").alias("b"))
        roots = components(known.unionByName(found))
        done = live.where("pivot").select("cid", F.lit(True).alias("done"))
        state = state.drop("label").join(roots.toDF("cid", "label"), "cid", "left").join(done, "cid", "left")
        state = materialize(state.select("cid", "cluster", "n", F.coalesce("label", "cid").alias("label"), (F.col("todo") & F.col("done").isNull()).alias("todo")), "cluster-state", rows)
        # what is left to compare lies between classes: all but the class with the most open members may give pivots
        per = state.where("todo").groupBy("cluster", "label").agg(F.sum("n").alias("n"))
        top = materialize(per.groupBy("cluster").agg(F.max(F.struct("n", "label"))["label"].alias("top")), "cluster-top", rows)
        state = materialize(state.join(top, "cluster", "left").select("cid", "cluster", "n", "label", "todo", (F.col("todo") & (F.col("label") != F.col("top"))).alias("may")), "cluster-state", rows)
        turn += 1
    return state.where("cid <> label").select(F.col("cid").alias("v"), F.col("label").alias("root"))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(t1, t2, least) for ``docs`` (d, text): for each distinct text the smallest d of its class."""
    t1, t2 = fingerprint(F.col("text"))
    packed = _batches(docs.where("text IS NOT NULL").select("d", t1.alias("t1"), t2.alias("t2"), "text"))
    totals = packed.agg(F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words")).first()
    n_docs, ranges = totals["docs"] or 0, 1
    while ranges * RANGE_SHINGLES < (totals["words"] or 0):
        ranges *= 2
    bits = RANGE_BITS + ranges.bit_length() - 1
    coded = coded_batches(packed, ranges, bits)
    sampled = materialize(sample_documents(coded, n_docs, bits), "samples")
    one = F.struct("batch", "at", "n", "bands", "samples")
    classes = sampled.groupBy("t1", "t2").agg(F.min("d").alias("d"), F.first(one).alias("one"))
    classes = materialize(classes.select("t1", "t2", "d", "one.*").withColumn("cid", F.monotonically_increasing_id()), "text-classes")
    clusters = components_with_roots(candidate_clusters(classes))
    wanted = materialize(clusters.join(classes.select("cid", "batch", "at"), "cid"), "wanted")
    roots = verified_classes(_vectors(coded, wanted, bits), n_docs, similarity)
    placed = materialize(classes.select("t1", "t2", "d", "cid").join(roots.toDF("cid", "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid")), "placed")
    least = materialize(placed.groupBy("root").agg(F.min("d").alias("least")), "least-ids")
    return materialize(placed.join(least, "root").select("t1", "t2", "least"), "near-classes")


def components_with_roots(found: DataFrame) -> DataFrame:
    """(cid, cluster), roots included."""
    return found.select(F.col("v").alias("cid"), F.col("root").alias("cluster")).unionByName(found.select(F.col("root").alias("cid"), F.col("root").alias("cluster")).distinct())


def mark_near(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, which has doc_id and text), class_id (the smallest doc_id of its class; null text: its own), kept and first.

    first holds for exactly one row of each class: that of the smallest doc_id, nulls last, and of equal ids the
    first row as written here. kept is the same, but that all rows of a class's smallest doc_id have it.
    """
    last = (1 << 63) - 1
    t1, t2 = fingerprint(F.col("text"))
    hashed = lambda h: F.when(F.col("text").isNotNull(), h)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("d"), F.monotonically_increasing_id().alias("n"), hashed(t1).alias("t1"), hashed(t2).alias("t2"))
    keyed = materialize(keyed, "near-rows")  # row numbers hold only once they are written
    classes = near_classes(keyed.select(F.col("n").alias("d"), F.col("row.text").alias("text")), similarity).withColumnRenamed("least", "name")
    named = keyed.where("t1 IS NOT NULL").groupBy("t1", "t2").agg(F.min(F.struct("d", "n")).alias("one")).join(classes, ["t1", "t2"])
    named = materialize(named, "class-texts")
    best = named.groupBy("name").agg(F.min("one").alias("best"))
    done = keyed.join(named.join(best, "name").select("t1", "t2", "best"), ["t1", "t2"], "left")
    own = F.coalesce("best.d", "d")
    first = F.col("best").isNull() | (F.col("best.n") == F.col("n"))
    kept = first | ((own == F.col("d")) & (own != last))
    return done.select("row", F.when(own != last, own).alias("class_id"), kept.alias("kept"), first.alias("first"))


def op7_weighted_minhash(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_near(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), "class_id", "kept")
