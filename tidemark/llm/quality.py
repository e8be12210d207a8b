"""Quality rules: length and repetition rules, and bands of n-gram perplexity a language (operator 9).

The model is a character n-gram model of order 4 with interpolated modified Kneser-Ney smoothing, one for each value
of ``lang``. Characters are Unicode code points as they stand: case, accents and scripts count, and there is no fixed
alphabet, so the model grows with the corpus. It is never in one place: counts, discounts and probabilities are tables
dealt by (language, n-gram), and the probabilities of all n-grams that are asked for are stored as sorted hash arrays,
one row a hash range. The text of a batch of documents (rows of a file that stand together) is read twice: first for
the counts and its distinct n-grams, which each hash range is asked for as sorted, packed hashes; then the answers and
the documents meet, which moves the text once. Nothing else moves a row a character or a row an n-gram and document.

An n-gram that only one text has (or copies of it) is not evidence for that text; it is left out and backs off, so what
is unlike all others can't vouch for itself. A document's score is its mean surprisal in bits a character; how widely
the surprisals of its characters spread is held against the others, too, for symbol spam is as predictable as prose on
average, but not from character to character. Each language's bands lie around the medians of its documents; they are
``BAND`` standard deviations wide on either side, and wider for short texts, which say less.

Results defined for odd input: a null text counts as empty (no words: base_failed); a null lang is one with the empty
string; documents with the same doc_id are judged one by one; a very long text is scored whole; ties don't matter, as
nothing is ranked; an empty table gives no rows; the columns of ``docs`` come back in the struct ``row``, so that no
name of theirs can clash.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textops
from .common import arrow_type, materialize, read_table, text_bytes, text_slices

ORDER, CODE_BITS = 4, 21
#: A document is rejected that lies further from its language's median, in standard deviations.
BAND = 4.0
#: Deviation in bits that one character adds to the mean and to the spread, for the widening by length; and the least deviation of a language.
CHAR_BITS, SPREAD_BITS, LEAST_BITS = 1.0, 2.0, 0.02
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rows of a file that make a batch; n-grams that a task holds before it merges equal ones; n-grams a hash range, and ranges at least.
BATCH_ROWS, HELD_GRAMS, RANGE_GRAMS, LEAST_RANGES = 4096, 1 << 21, 1 << 17, 64
#: Bits of a character of a language that the model doesn't know (any code point may come), and steps a bit of a stored surprisal.
UNKNOWN_BITS, STEPS = 20.0, 1024
#: Steps a bit of the histograms that the bands come from.
BINS = 500
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#*$%&|<>")] = True


def base_features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each document."""
    n = len(offsets) - 1
    starts, stops, first = textops.words(data, offsets)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    out = {"n_words": np.diff(first), "word_chars": total(((data & 0xC0) != 0x80) & ~gap), "n_symbols": total(_MARKS[data])}

    line_start = np.union1d(np.flatnonzero(data == 10) + 1, offsets[:-1])
    line_start = line_start[line_start < len(data)]
    owner = np.searchsorted(offsets, line_start, side="right") - 1
    line_stop = np.append(line_start[1:], len(data))[: len(line_start)]
    line_stop = line_stop - (data[line_stop - 1] == 10)
    wordy = np.searchsorted(starts, line_stop) > np.searchsorted(starts, line_start)
    owner, h = owner[wordy], textops.hash_spans(data, line_start[wordy], line_stop[wordy])
    order = np.lexsort((h, owner))
    same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out["n_dup_lines"] = np.bincount(owner[order][1:][same], minlength=n)

    win, at = textops.windows(textops.hash_spans(data, starts, stops), first, WINDOW)
    doc = np.repeat(np.arange(n), np.diff(first))
    mixed = textops.mix(win ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(mixed)
    same = mixed[order][1:] == mixed[order][:-1]
    twice = np.zeros(len(mixed), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(starts) + WINDOW + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(edge)[: len(starts)] > 0], minlength=n)
    return out


def code_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character of each document the three code points before it, packed (line ends stand before the document), the code point itself, and where each document's begin."""
    pos = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(pos, offsets)
    lead = data[pos]
    code = lead.astype(np.int64)
    for n, least, end, mask in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0x100, 0x07)):
        some = np.flatnonzero((lead >= least) & (lead < end))
        long = code[some] & mask
        for k in range(1, n):
            long = long << 6 | data[pos[some] + k] & 0x3F
        code[some] = long
    context = np.zeros(len(code), np.int64)
    for k in range(1, ORDER):
        context[k:] |= code[:-k] << CODE_BITS * (k - 1) if len(code) > k else 0
    starts = at[:-1][np.diff(at) > 0]
    for nth in range(ORDER - 1):  # the first characters of each document
        own = starts + nth
        own = own[(own < len(code)) & (own < np.append(starts[1:], len(code)))]
        packed = np.zeros(len(own), np.int64)
        for k in range(1, ORDER):
            packed |= (code[own - k] if k <= nth else 10) << CODE_BITS * (k - 1)
        context[own] = packed
    return context, code, at


def _langs(column: pa.Array) -> list[str]:
    return [x or "" for x in column.cast(pa.string()).to_pylist()]


def _hash(lang: np.ndarray, context: np.ndarray, code: np.ndarray) -> np.ndarray:
    return textops.mix(context.astype(np.uint64) ^ textops.mix(code.astype(np.uint64) ^ lang))


def _lang_hash(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    return textops.hash_spans(data, offsets[:-1], offsets[1:])


class Place:
    """Where 64-bit hashes stand in a sorted array of them: the leading bits say where to look."""

    def __init__(self, known: np.ndarray):
        bits = max(1, len(known).bit_length() + 1)
        self.known, self.shift = np.append(known, np.uint64(0)), np.uint64(64 - bits)
        self.start = np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self.start[(h >> self.shift).astype(np.int64)]
        left = np.flatnonzero(self.known[at] != h)
        while len(left):
            at[left] += 1
            if (at[left] >= len(self.known)).any():
                raise ValueError("a batch holds n-grams that it did not ask for: its rows changed between two readings")
            left = left[self.known[at[left]] != h[left]]
        return at


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(h, lang, context, code, n, first, last), ascending by h, with equal n-grams joined: n summed, the least and the greatest hash of a text."""
    if len(parts) == 1:
        return parts[0]
    h, lang, context, code, n, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    one = order[start]
    return h[one], lang[one], context[one], code[one], np.add.reduceat(n[order], start), np.minimum.reduceat(lo[order], start), np.maximum.reduceat(hi[order], start)


def _counted(part: pa.RecordBatch, ids: dict[str, int]) -> tuple[np.ndarray, ...]:
    """What _merged gives, for a slice of documents."""
    hashes = (part.column("_hash").to_numpy() >> 32).astype(np.int32)
    order = np.argsort(hashes)  # in this order the first and the last text that has an n-gram are those of least and greatest hash
    part = part.take(pa.array(order))
    data, offsets = text_bytes(part.column("_text"))
    context, code, at = code_grams(data, offsets)
    each = np.diff(at)
    lang = np.array([ids.setdefault(x, len(ids)) for x in _langs(part.column("_lang"))], np.int64)
    h = _hash(np.repeat(_lang_hash(part.column("_lang")), each), context, code)
    known = np.unique(h)
    place = Place(known).find(h)
    owner = np.repeat(np.arange(len(each)), each)
    first, last, one = (np.empty(len(known), np.int64) for _ in range(3))
    last[place] = owner
    first[place[::-1]] = owner[::-1]
    one[place] = np.arange(len(place))
    hashes = hashes[order]
    return known, lang[owner[one]], context[one], code[one], np.bincount(place, minlength=len(known)), hashes[first], hashes[last]


GATHERED = "lang string, context long, code int, n long, first int, last int, batch long, hashes binary"


def gather(docs: DataFrame) -> DataFrame:
    """One reading of ``docs`` (lang, text), written: rows (lang, context, code, n, first, last), how often an n-gram occurs in what a task reads, and the least and greatest hash of a text that has it; and rows (batch, n, hashes), the distinct n-grams of a batch."""

    def count(batches):
        ids: dict[str, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        own: list[tuple[np.ndarray, ...]] = []
        now = None
        for batch in batches:
            numbers = batch.column("_batch").to_numpy()
            for lo, hi in _runs(numbers):
                if numbers[lo] != now:
                    yield from close(now, own, held)
                    if sum(len(x[0]) for x in held) > HELD_GRAMS:
                        held = [_merged(held)]
                        if len(held[0][0]) > HELD_GRAMS // 2:
                            yield counts(held, ids)
                            held, ids = [], {}
                    now, own = numbers[lo], []
                for part in text_slices(batch.slice(lo, hi - lo), "_text"):
                    own.append(_counted(part, ids))
                    if sum(len(x[0]) for x in own) > HELD_GRAMS // 4:
                        own = [_merged(own)]
        yield from close(now, own, held)
        if held:
            yield counts(held, ids)

    def close(now, own, held):
        if own:
            whole = _merged(own)
            if len(whole[0]):
                held.append(whole)
                none = pa.nulls(1)
                yield pa.record_batch([none.cast(pa.string()), none.cast(pa.int64()), none.cast(pa.int32()), pa.array([len(whole[0])]), none.cast(pa.int32()), none.cast(pa.int32()), pa.array([int(now)]), pa.array([textops.pack_keys(whole[0])], pa.binary())], schema=arrow_type(GATHERED))

    def counts(held, ids):
        _, lang, context, code, *rest = _merged(held)
        names = pa.DictionaryArray.from_arrays(pa.array(lang.astype(np.int32)), pa.array(list(ids), pa.string())).cast(pa.string())
        return pa.record_batch([names, pa.array(context), pa.array(code.astype(np.int32)), *map(pa.array, rest), pa.nulls(len(lang)).cast(pa.int64()), pa.nulls(len(lang)).cast(pa.binary())], schema=arrow_type(GATHERED))

    table, batch = in_batches(docs)
    return materialize(table.select(batch.alias("_batch"), F.col("lang").cast("string").alias("_lang"), F.col("text").alias("_text"), F.xxhash64("text").alias("_hash")).mapInArrow(count, GATHERED), "gathered")


class Trained(NamedTuple):
    """Modified Kneser-Ney, interpolated: for each order k a table (lang, context, code, p, back, lead). ``back`` is what the context leaves to the order below, ``lead`` marks one row a context. ``even`` is the even distribution of each language, ``seen`` all n-grams of the corpus, those of one text, too, ``gathered`` what gather() made of its ``table``."""

    orders: dict[int, DataFrame]
    even: DataFrame
    seen: DataFrame
    gathered: DataFrame
    table: DataFrame


def _shorter(k: int) -> Column:
    """The context of order k without its farthest characters."""
    return F.col("context").bitwiseAND(F.lit((1 << (k - 1) * CODE_BITS) - 1))


def train(docs: DataFrame) -> Trained:
    """The model of ``docs`` (lang, text); n-grams of one text only, however many copies there are, are left out.

    A context has at most as many characters after it as there are code points, so its window is bounded.
    """
    table, _ = in_batches(docs)
    gathered = gather(table)
    counted = gathered.where("batch IS NULL").groupBy("lang", "context", "code").agg(F.sum("n").alias("c"), F.min("first").alias("first"), F.max("last").alias("last"))
    seen = materialize(counted.select("lang", "context", "code", F.when(F.col("first") != F.col("last"), F.col("c")).alias("c")), "seen-grams")
    levels = {ORDER: seen.where("c IS NOT NULL")}
    for k in range(ORDER - 1, 0, -1):  # lower orders count the distinct characters that stand before them
        levels[k] = materialize(levels[k + 1].groupBy("lang", _shorter(k).alias("context"), "code").agg(F.count("*").alias("c")), "grams")
    even = materialize(levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("low")), "even")
    orders: dict[int, DataFrame] = {}
    for k in range(1, ORDER + 1):
        t = [F.greatest(F.lit(1), F.count(F.when(F.col("c") == j, 1))) for j in range(1, 5)]
        t1, t2, t3, t4 = (F.col(f"t{j}") for j in range(1, 5))
        y = t1 / (t1 + 2 * t2)
        clip = lambda x, most: F.least(F.greatest(x, F.lit(0.1)), F.lit(most))
        off = levels[k].groupBy("lang").agg(*[x.alias(f"t{j + 1}") for j, x in enumerate(t)]).select("lang", clip(1 - 2 * y * t2 / t1, 0.9).alias("d1"), clip(2 - 3 * y * t3 / t2, 1.9).alias("d2"), clip(3 - 4 * y * t4 / t3, 2.9).alias("d3"))
        cut = levels[k].join(materialize(off, "discounts"), "lang").withColumn("cut", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = Window.partitionBy("lang", "context")
        one = cut.select("lang", "context", "code", "c", "cut", F.sum("c").over(context).alias("total"), F.sum("cut").over(context).alias("left"), (F.row_number().over(context.orderBy("code")) == 1).alias("lead"))
        below = even if k == 1 else orders[k - 1].select("lang", F.col("context").alias("_short"), "code", F.col("p").alias("low"))
        one = one.join(below, "lang") if k == 1 else one.withColumn("_short", _shorter(k - 1)).join(below, ["lang", "_short", "code"])
        back = F.col("left") / F.col("total")
        orders[k] = materialize(one.select("lang", "context", "code", ((F.col("c") - F.col("cut")) / F.col("total") + back * F.col("low")).alias("p"), back.alias("back"), "lead"), "probabilities")
    return Trained(orders, even, seen, gathered, table)


def surprisals(wanted: DataFrame, model: Trained) -> DataFrame:
    """(lang, context, code, bits) for distinct ``wanted`` (lang, context, code); unseen n-grams back off, and only they are looked up in the order below."""
    asked, tried = wanted, {}
    for k in range(ORDER, 0, -1):
        tried[k] = materialize(asked.join(model.orders[k].select("lang", "context", "code", "p"), ["lang", "context", "code"], "left"), "asked")
        if k > 1:
            asked = tried[k].where("p IS NULL").select("lang", _shorter(k - 1).alias("context"), "code").distinct()
    found = None
    for k in range(1, ORDER + 1):
        missed = tried[k].where("p IS NULL").drop("p").join(model.orders[k].where("lead").select("lang", "context", "back"), ["lang", "context"], "left")
        if k == 1:
            missed = missed.join(model.even, "lang", "left").withColumn("low", F.coalesce("low", F.lit(2.0**-UNKNOWN_BITS)))
        else:
            missed = missed.withColumn("_short", _shorter(k - 1)).join(found.select("lang", F.col("context").alias("_short"), "code", F.col("p").alias("low")), ["lang", "_short", "code"])
        p = F.coalesce("back", F.lit(1.0)) * F.col("low")
        found = tried[k].where("p IS NOT NULL").unionByName(missed.select("lang", "context", "code", p.alias("p")))
        if k < ORDER:
            found = materialize(found, "answered")
    return found.select("lang", "context", "code", (-F.log2("p")).alias("bits"))


RANGED = "range int, kind int, batch long, n int, hashes binary, bits binary"


def hash_arrays(priced: DataFrame, range_bits: int) -> DataFrame:
    """``priced`` (lang, context, code, bits) as sorted arrays: rows of the shape RANGED, a hash range in one row or a few."""
    keyed = "range int, h long, steps int"

    def key(batches):
        for batch in batches:
            h = _hash(_lang_hash(batch.column("lang")), batch.column("context").to_numpy(), batch.column("code").to_numpy())
            steps = np.clip(np.round(batch.column("bits").to_numpy() * STEPS), 0, 65535).astype(np.int32)
            yield pa.record_batch([pa.array((h >> np.uint64(64 - range_bits)).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(steps)], schema=arrow_type(keyed))

    def cut(batches):
        for batch in batches:
            ranges, h, steps = (batch.column(i).to_numpy() for i in range(3))
            edge = np.flatnonzero(ranges[1:] != ranges[:-1]) + 1
            rows = [(int(ranges[lo]), 0, 0, hi - lo, textops.pack_keys(h[lo:hi].view(np.uint64)), textops.squeeze(steps[lo:hi].astype("<u2"))) for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(h)], strict=True) if hi > lo]
            yield _record_batch(rows, RANGED)

    rows = priced.select(F.coalesce("lang", F.lit("")).alias("lang"), "context", "code", "bits").mapInArrow(key, keyed)
    # the numbers of a range agree in their sign, so signed order is the order of the hashes
    return materialize(rows.repartition("range").sortWithinPartitions("range", "h").mapInArrow(cut, RANGED), "hash-arrays")


def _record_batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = arrow_type(ddl)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _runs(ids: np.ndarray):
    """(start, stop) of the stretches of equal entries."""
    edge = np.flatnonzero(ids[1:] != ids[:-1]) + 1
    return [(lo, hi) for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)], strict=True) if hi > lo]


def in_batches(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` and the column that says which batch a row is in: its file and place there, which any reading of the file finds again. What isn't a Parquet table is written as one first."""
    if not re.fullmatch(r"Relation \[.*\] parquet\s*", docs._jdf.queryExecution().analyzed().toString(), re.S):
        docs = materialize(docs, "rows")
    return docs, F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / BATCH_ROWS))


def _asked(gathered: DataFrame, range_bits: int) -> DataFrame:
    """Rows RANGED of kind 1: the distinct n-grams of each batch, by hash range."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h = textops.unpack_keys(row["hashes"], row["n"])
                ranges = (h >> np.uint64(64 - range_bits)).astype(np.int64)
                yield _record_batch([(int(ranges[lo]), 1, row["batch"], hi - lo, textops.pack_keys(h[lo:hi]), None) for lo, hi in _runs(ranges)], RANGED)

    return gathered.where("batch IS NOT NULL").select("batch", "n", "hashes").mapInArrow(ask, RANGED)


def _answered(arrays: DataFrame, asked: DataFrame) -> DataFrame:
    """(batch, kind 0, n, hashes, bits, docs): the stored surprisals, in the order asked. A task holds the arrays of one range; what is asked of it passes."""

    def answer(batches):
        now, parts, ready = None, [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["range"] != now:
                    now, parts, ready = row["range"], [], None
                if row["kind"] == 0:
                    parts.append((textops.unpack_keys(row["hashes"], row["n"]), textops.unsqueeze(row["bits"], "<u2")))
                    continue
                if ready is None:
                    known, steps = (np.concatenate(x) for x in zip(*parts, strict=True))
                    ready = Place(known), steps
                h = textops.unpack_keys(row["hashes"], row["n"])
                out.append((row["batch"], 0, row["n"], row["hashes"], textops.squeeze(ready[1][ready[0].find(h)]), None))
            yield _record_batch(out, MET)

    both = arrays.unionByName(asked).repartition("range").sortWithinPartitions("range", "kind", "batch")
    return both.mapInArrow(answer, MET)


MET = "batch long, kind int, n int, hashes binary, bits binary, docs binary"


def score(docs: DataFrame, model: Trained, keep: list[str] | None = None, trained_on_docs: bool = False) -> DataFrame:
    """``row`` (a struct of the columns ``keep``, by default all), the base counts, bits (mean surprisal), spread (standard deviation of the surprisals; both null for an empty text) and n_scored of each of ``docs`` (lang, text).

    ``trained_on_docs``: the model is that of these documents, so it has seen all their n-grams.
    """
    table, batch = in_batches(model.table if trained_on_docs else docs)
    keep = docs.columns if keep is None else keep
    row_type = StructType([docs.schema[c] for c in keep])
    source = table.select(batch.alias("_batch"), F.col("lang").cast("string").alias("_lang"), F.col("text").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"))
    gathered = model.gathered if trained_on_docs else gather(table)
    seen = model.seen.drop("c") if trained_on_docs else gathered.where("batch IS NULL").select("lang", "context", "code").distinct()
    priced = materialize(surprisals(seen, model), "priced")
    range_bits = max(LEAST_RANGES.bit_length() - 1, (priced.count() // RANGE_GRAMS).bit_length())
    answers = _answered(hash_arrays(priced, range_bits), _asked(gathered, range_bits))
    text_apart = "text" not in keep

    def pack(batches):
        write = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for batch in batches:
            ids = batch.column("_batch").to_numpy()
            for lo, hi in _runs(ids):
                for part in text_slices(batch.slice(lo, hi - lo), "_text"):
                    sink = pa.BufferOutputStream()
                    names = ["_lang", "_row", *(["_text"] if text_apart else [])]
                    sent = part.select(names)
                    with pa.ipc.new_stream(sink, sent.schema, options=write) as f:
                        f.write_batch(sent)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(([int(ids[lo])], [1], [None], [None], [None], [sink.getvalue().to_pybytes()]), arrow_type(MET).types, strict=True)], schema=arrow_type(MET))

    dealt = answers.unionByName(source.mapInArrow(pack, MET)).repartition("batch").sortWithinPartitions("batch", "kind")
    schema = StructType().add("row", row_type, False)
    schema = StructType(schema.fields + StructType.fromDDL(", ".join(f"{c} long" for c in BASE) + ", bits double, spread double, n_scored long").fields)

    def run(batches):
        now, parts, ready = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                number, kind, n = (batch.column(j)[i].as_py() for j in range(3))
                if number != now:
                    now, parts, ready = number, [], None
                if kind == 0:
                    parts.append((textops.unpack_keys(batch.column(3)[i].as_py(), n), textops.unsqueeze(batch.column(4)[i].as_py(), "<u2")))
                    continue
                if ready is None:
                    h, steps = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), np.empty(0, np.uint16))
                    order = np.argsort(h, kind="stable")
                    ready, parts = (Place(h[order]), steps[order] / STEPS), []
                for part in pa.ipc.open_stream(batch.column(5)[i].as_buffer()):
                    yield scored(part, *ready)

    def scored(part, known, known_bits):
        row = part.column("_row")
        data, offsets = text_bytes(part.column("_text") if text_apart else row.field("text"))
        base, (context, code, at) = base_features(data, offsets), code_grams(data, offsets)
        n = np.diff(at)
        bits = known_bits[known.find(_hash(np.repeat(_lang_hash(part.column("_lang")), n), context, code))]
        mean, square = (np.diff(np.concatenate([[0], np.cumsum(x)])[at]) / np.maximum(n, 1) for x in (bits, bits * bits))
        spread = np.sqrt(np.maximum(square - mean * mean, 0))
        return pa.record_batch([row, *(pa.array(base[c].astype(np.int64)) for c in BASE), pa.array(mean, mask=n == 0), pa.array(spread, mask=n == 0), pa.array(n)], names=["row", *BASE, "bits", "spread", "n_scored"])

    return dealt.mapInArrow(run, schema)


def _quartiles(scored: DataFrame, value: str, name: str) -> DataFrame:
    """(lang, name: three quartiles) from a histogram: at most a few thousand rows a language, whatever the number of documents."""
    counts = scored.groupBy("_lang", F.round(F.col(value) * BINS).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    lang = Window.partitionBy("_lang")
    sums = counts.select("_lang", "bin", F.sum("n").over(lang.orderBy("bin")).alias("upto"), F.sum("n").over(lang).alias("all"))
    return sums.groupBy("_lang").agg(F.array(*[F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) / BINS for q in (0.25, 0.5, 0.75)]).alias(name))


def judge(scored: DataFrame) -> DataFrame:
    """``scored`` (a written table) with base_failed, perplexity and kept. Bands come from the quartiles of all documents that pass the base rules."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    lang = F.coalesce(F.col("row.lang").cast("string"), F.lit(""))
    fair = scored.where(~failed & F.col("bits").isNotNull()).select(lang.alias("_lang"), "bits", "spread")
    bands = materialize(_quartiles(fair, "bits", "_q").join(_quartiles(fair, "spread", "_qs"), "_lang"), "bands")

    def within(value: str, q: Column, char: float) -> Column:
        width = F.sqrt(F.pow(F.greatest((q[2] - q[0]) / 1.349, F.lit(LEAST_BITS)), 2) + F.lit(char**2) / F.col("n_scored"))
        return F.abs(F.col(value) - q[1]) <= BAND * width

    inside = within("bits", F.col("_q"), CHAR_BITS) & within("spread", F.col("_qs"), SPREAD_BITS)
    return (
        scored.withColumn("_lang", lang).join(bands, "_lang", "left").drop("_lang")
        .withColumn("base_failed", failed).withColumn("perplexity", F.pow(F.lit(2.0), F.col("bits")))
        .withColumn("kept", ~failed & F.coalesce(inside, F.lit(False))).drop("_q", "_qs")
    )


def op9_ngram_perplexity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = materialize(score(docs, train(docs), ["doc_id", "lang"], trained_on_docs=True), "scored")
    return judge(scored).select(F.col("row.doc_id").cast("long").alias("doc_id"), *BASE, "base_failed", "kept", "perplexity")
