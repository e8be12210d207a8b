"""One JSON array of any size, on one line or many, read by many tasks.

Spark's text reader cuts the file into byte ranges at closing braces, and a task packs what it reads into chunks. What a
chunk does to the state of a JSON reader composes over chunks: it flips "inside a string" by its number of quotes, and
changes the depth by an amount that is known for either state at its start. So sums over the chunks before it, without
their text, give each chunk its state, and each chunk finds the ends of elements on its own. Elements within a chunk are
rows at once; what a chunk holds before its first cut and after its last is joined to the elements that run over chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import written

#: Bytes of a chunk; a single longer piece between two closing braces is a chunk of its own.
CHUNK = 4 << 20
_QUOTE, _ESCAPE, _COMMA = b'"'[0], b"\\"[0], b","[0]


def _escaped(data: np.ndarray) -> np.ndarray:
    """Which bytes follow an odd run of backslashes."""
    slash = data == _ESCAPE
    out = np.zeros(len(data), bool)
    edges = np.flatnonzero(np.diff(slash, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    odd = ends[(ends - begins) % 2 == 1]
    out[odd[odd < len(data)]] = True
    # within a run every second backslash is escaped, which changes nothing here: only quotes are asked for
    return out


def _structure(text: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, which of them are outside of strings, and each one's change of depth."""
    data = np.frombuffer(text, np.uint8)
    quotes = (data == _QUOTE) & ~_escaped(data)
    # a byte for each byte of the text: a chunk's arrays are a few times its size
    outside = np.logical_xor.accumulate(quotes) == inside
    opens, closes = (data == b"["[0]) | (data == b"{"[0]), (data == b"]"[0]) | (data == b"}"[0])
    change = opens.view(np.int8) - closes.view(np.int8)
    change[~outside] = 0
    return data, outside, change


def _chunks(batches):
    """Pieces in their order to chunks of one split each, with what they do to a reader's state."""
    held: list[bytes] = []
    size, seq, at = 0, 0, (None, None)

    def chunk():
        text = b"}".join([*held, b""])
        quotes = int(((d := np.frombuffer(text, np.uint8)) == _QUOTE)[~_escaped(d)].sum())
        deltas = [int(_structure(text, inside)[2].sum(dtype=np.int64)) for inside in (False, True)]
        return pa.record_batch([pa.array([c]) for c in (at[0], at[1], seq, quotes, *deltas)] + [pa.array([text], pa.binary())], names=["path", "split_start", "seq", "quotes", "from_outside", "from_inside", "text"])

    for batch in batches:
        for path, start, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (size >= CHUNK or at != (path, start)):
                yield chunk()
                held, size, seq = [], 0, seq + 1 if at == (path, start) else 0
            at = (path, start)
            held.append(piece)
            size += len(piece) + 1
    if held:
        yield chunk()


def chunks(spark: SparkSession, glob: str) -> DataFrame:
    """path, split_start, seq, text and the changes of state of each chunk. The brace that ends a piece is put back; behind the file's last piece it follows the array's end and is ignored."""
    pieces = spark.read.option("lineSep", "}").text(glob).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split_start"), F.col("value").cast("binary").alias("piece"))
    return written(pieces.mapInArrow(_chunks, "path string, split_start long, seq long, quotes long, from_outside long, from_inside long, text binary"))


def states(cut: DataFrame) -> DataFrame:
    """path, split_start, seq, and inside and depth at the start of each chunk: sums over numbers, one row a chunk."""
    before = Window.partitionBy("path").orderBy("split_start", "seq").rowsBetween(Window.unboundedPreceding, -1)
    quoted = cut.select("path", "split_start", "seq", "from_outside", "from_inside", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    delta = F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    # a window's values are summed in a window of the same order, so rows are sorted once
    return quoted.withColumn("delta", delta).withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0))).select("path", "split_start", "seq", "inside", "depth")


#: Parts of a chunk: its text before the first cut, whole elements, its text after the last cut, and the same behind the array's end.
HEAD, WHOLE, TAIL, BEHIND = 0, 1, 2, 3


def _parts(batches):
    """path, split_start, seq, part, k, text of chunks with their states; k counts whole elements."""
    for batch in batches:
        for i in range(batch.num_rows):  # one chunk at a time
            path, start, seq, inside, depth, text = (batch.column(c)[i].as_py() for c in ("path", "split_start", "seq", "inside", "depth", "text"))
            data, outside, change = _structure(text, inside)
            level = np.cumsum(change, dtype=np.int32)
            level += depth
            cuts = np.flatnonzero(outside & (((data == _COMMA) & (level == 1)) | ((change == 1) & (level == 1)) | ((change == -1) & (level == 0))))
            ended = np.flatnonzero((change == -1) & (level == 0))  # behind the end nothing counts, like the last piece's brace
            if len(ended):
                cuts = cuts[cuts <= ended[0]]
            rows = [(HEAD, 0, text[: cuts[0]] if len(cuts) else text)]
            rows += [(WHOLE, k, text[a + 1 : b]) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))]
            if len(cuts):
                rows.append((BEHIND, 0, b"") if len(ended) else (TAIL, 0, text[cuts[-1] + 1 :]))
            part, k, texts = zip(*rows, strict=True)
            n = len(rows)
            yield pa.record_batch([pa.array([path] * n), pa.array([start] * n), pa.array([seq] * n), pa.array(part, pa.int32()), pa.array(k, pa.int64()), pa.array(texts, pa.binary())], names=["path", "split_start", "seq", "part", "k", "text"])


def elements(spark: SparkSession, glob: str) -> DataFrame:
    """path, at (split_start, seq, part, k: ascending in the order of the array) and raw, the text of each element of the array of each file.

    A file that doesn't begin with '[', or whose array has no end, is an error of the job.
    """
    cut = chunks(spark, glob)
    keys = ["path", "split_start", "seq"]
    state = written(states(cut))
    # what opens the file, and what its chunks add up to
    heads = cut.where("split_start = 0 AND seq = 0").select("path", F.regexp_extract(F.col("text").cast("string"), r"^\s*(.)", 1).alias("c"))
    last = cut.join(state, keys).groupBy("path").agg(F.sum("quotes").alias("quotes"), F.sum(F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))).alias("depth"))
    # the last piece's own brace closes once more than the file does
    states_of_files = heads.join(last, "path").select("path", (F.col("c").eqNullSafe("[") & (F.col("quotes") % 2 == 0) & (F.col("depth") == -1)).alias("good"))
    worst = states_of_files.agg(F.count("*").alias("n"), F.min(F.when(~F.col("good"), F.col("path"))).alias("path")).first()
    if not worst["n"] or worst["path"] is not None:
        raise ValueError(f"{worst['path'] or glob} holds no array")
    parts = written(cut.select(*keys, "text").join(state, keys).mapInArrow(_parts, "path string, split_start long, seq long, part int, k long, text binary"))
    whole = parts.where(F.col("part") == WHOLE).select("path", F.struct("split_start", "seq", "part", "k").alias("at"), "text")
    # an element that runs over chunks: a tail, whole chunks without a cut, and the next head
    ends = parts.where(F.col("part") != WHOLE).select(*keys, "part", "k", "text")
    order = Window.partitionBy("path").orderBy("split_start", "seq", "part")
    number = F.sum((F.col("part") != HEAD).cast("long")).over(order)
    numbered = ends.select(*keys, "part").withColumn("run", number)
    opened = numbered.where(F.col("part") == TAIL).select("path", "run")
    runs = numbered.join(opened, ["path", "run"]).join(ends, [*keys, "part"])
    spanning = runs.groupBy("path", "run").agg(F.array_sort(F.collect_list(F.struct("split_start", "seq", "part", "k", "text"))).alias("p"))
    spanning = spanning.select("path", F.struct(*[F.col("p")[0][c].alias(c) for c in ("split_start", "seq", "part", "k")]).alias("at"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["text"])).alias("text"))
    found = whole.unionByName(spanning).select("path", "at", F.col("text").cast("string").alias("raw"))
    return found.where(~F.col("raw").rlike(r"^\s*$"))
