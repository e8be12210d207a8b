"""Line dedup by distributed prefix doubling over line-ID sequences (operator 4); DataFrame operations only.

The text of all documents is one sequence of lines (lines without a word are left out). Prefix doubling gives
each position of the sequence the rank of the 2**k lines that begin there, within its document: round 0 ranks
single lines, round k + 1 ranks pairs of ranks that lie 2**k apart. All positions of one rank are the
longest-common-prefix interval of depth 2**k of the suffix array; a rank is named by the interval's least
position, and positions alone in their interval drop out, for no repeated run begins there. Any depth x between
2**k and 2**(k + 1) is the pair of the ranks at both ends of the run.

A repeated run counts from ``min_words`` words on (MIN_WORDS by default; 1: every repeated line). Two runs a position
are looked up in the intervals: the shortest that begins there and the shortest that ends there; every line of a run of
``min_words`` words or more lies in one of them that is within the run, and a part of a repeated run is repeated. The
rounds go on until these depths are reached or no rank is shared any more. Later copies, in ascending (doc_id, text
hash, line), are deleted; together they are the later copies of all repeated runs. repeated_runs() reports maximal runs:
its rounds go on until no rank is shared; looked-up runs on one diagonal (the same distance before them, in one other
document) that touch are one run, which is then stretched at both ends by falling powers of two of the ranks.

What is left out of a full suffix array is the order of intervals among each other: deletion needs to know which
suffixes share an interval, and which of them comes first in the corpus, not which sorts before which.

Results defined for odd input: lines are compared without white space at their ends; a null text stays null; an
empty text stays empty; rows equal in doc_id and text are one document and are treated alike; null doc_ids come
after all others; lines without a word stay; an empty table gives no rows; a text of any length is split
once; the columns of ``docs`` come back in a struct, so that no name of theirs can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fingerprint, materialize, read_table

MIN_WORDS = 50
#: White space between words.
BLANK = " \t\n\x0b\x0c\r"


def _n_words(line: Column) -> Column:
    """Words of a line without white space at its ends: its single blanks and one more, where it has no other white space; else by a pattern."""
    odd = F.translate(line, BLANK[1:], "") != line
    plain = F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1
    return F.when(odd | F.contains(line, F.lit("  ")), F.size(F.split(line, r"[\x20\x09-\x0D]+"))).otherwise(plain).cast("long")


def _line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """One row a line with words: its position, its document, and how many lines the shortest runs from it and up to it have."""
    h1, h2 = fingerprint(F.col("_text"))
    lines = docs.where("_text IS NOT NULL").select(F.coalesce(F.col("_doc"), F.lit((1 << 63) - 1)).alias("d"), h1.alias("t"), h2.alias("t2"), F.posexplode(F.split("_text", "\n")).alias("line", "raw"))
    words = lines.withColumn("raw", F.btrim("raw", F.lit(BLANK))).where("raw <> ''")
    l1, l2 = fingerprint(F.col("raw"))
    rows = words.select("d", "t", "t2", "line", l1.alias("l1"), l2.alias("l2"), _n_words(F.col("raw")).alias("w")).distinct()
    own = Window.partitionBy("d", "t", "t2").orderBy("line")
    # words up to and before each line; the next two windows are over these sums
    sums = rows.withColumn("upto", F.sum("w").over(own)).withColumn("before", F.col("upto") - F.col("w")).withColumn("at", F.row_number().over(own)).withColumn("all", F.sum("w").over(Window.partitionBy("d", "t", "t2")))
    # from the end, as a frame that grows is summed row by row, while one that shrinks would be summed anew for each row
    ahead = Window.partitionBy("d", "t", "t2").orderBy(-F.col("before")).rangeBetween(Window.unboundedPreceding, -min_words)
    behind = Window.partitionBy("d", "t", "t2").orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words)
    found = sums.withColumn("next", F.min("at").over(ahead)).withColumn("last", F.max("at").over(behind)).withColumn("count", F.count("*").over(Window.partitionBy("d", "t", "t2")))
    enough = F.col("all") - F.col("before") >= min_words
    return materialize(
        found.select(
            "d", "t", "t2", "line", "l1", "l2", F.col("at").cast("long").alias("at"),
            F.when(enough, F.coalesce(F.col("next"), F.col("count") + 1) - F.col("at")).cast("int").alias("from_here"),
            F.when(F.col("upto") >= min_words, F.col("at") - F.coalesce(F.col("last"), F.lit(0))).cast("int").alias("up_to_here"),
            (F.monotonically_increasing_id()).alias("pos"), F.col("count").cast("long").alias("count"), "before", "upto",
        ),
        "lines",
    )


def _ranked(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Positions whose keys occur twice or more, with the least position as their rank.

    Least positions are summed before they are shuffled, and are a table of their own with one row a repeated
    key, so that adaptive execution can split a frequent key on the side of the positions.
    """
    intervals = materialize(keyed.groupBy(*keys).agg(F.min("pos").alias("rank"), F.count("*").alias("n")).where("n > 1").drop("n"), "intervals")
    return keyed.join(intervals, keys).drop(*keys)


def _later_copies(docs: DataFrame, min_words: int, levels: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The line table, and (d, t, t2, at, x, begin, first): runs of x lines from the at-th of a document, and the position of their first copy, which is another one.

    ``levels`` gets (pos, rank) of each depth 1, 2, 4, ..., until no rank is shared; without it the rounds end with the
    longest run to look up.
    """
    lines = _line_table(docs, min_words)
    start = F.col("pos")
    # the runs to look up; a document's positions are consecutive, as one task wrote them in order
    runs = materialize(
        lines.where("from_here IS NOT NULL").select(start.alias("begin"), F.col("from_here").alias("x"), "d", "t", "t2", "at")
        .unionByName(lines.where("up_to_here IS NOT NULL").select((start - F.col("up_to_here") + 1).alias("begin"), F.col("up_to_here").alias("x"), "d", "t", "t2", (F.col("at") - F.col("up_to_here") + 1).alias("at"))).distinct(),
        "runs",
    )
    longest = runs.agg(F.max("x").alias("x")).first()["x"] or 0
    ranks = materialize(_ranked(lines.select("pos", "l1", "l2", (start - F.col("at") + F.col("count")).alias("end")), ["l1", "l2"]), "ranks")
    hits, depth = [], 1
    while (depth <= longest or levels is not None) and not ranks.isEmpty():
        if levels is not None:
            levels.append(ranks.select("pos", "rank"))
        mine = runs.where((F.col("x") >= depth) & (F.col("x") < 2 * depth)).withColumn("second", F.col("begin") + F.col("x") - depth)
        rank = ranks.select("pos", "rank")
        tested = mine.join(rank.toDF("begin", "r1"), "begin")
        tested = tested.withColumn("r2", F.col("r1")) if depth == 1 else tested.join(rank.toDF("second", "r2"), "second")
        if depth <= longest:
            hits.append(tested.select("x", "r1", "r2", "d", "t", "t2", "at", "begin"))
        if 2 * depth > longest and levels is None:
            break
        pairs = ranks.join(rank.select((F.col("pos") - depth).alias("pos"), F.col("rank").alias("other")), "pos").where(F.col("pos") + 2 * depth - 1 <= F.col("end"))
        ranks = materialize(_ranked(materialize(pairs.withColumnRenamed("rank", "one"), "pairs"), ["one", "other"]), "ranks")
        depth *= 2
    if not hits:
        return lines, None
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    found = materialize(found, "hits")
    key, place = ["x", "r1", "r2"], F.struct("d", "t", "t2", "at", "begin")
    first = materialize(found.groupBy(*key).agg(F.min(place).alias("one"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-copies")
    return lines, found.join(first, key).where(place > F.col("one")).select("d", "t", "t2", "at", "x", "begin", F.col("one.begin").alias("first"))


def _joined(later: DataFrame, *along: str) -> DataFrame:
    """Rows (d, t, t2, at, until, ...): stretches of a document's lines that overlap or touch, and agree in ``along``, as one, with the least begin and first where there are such columns."""
    own = Window.partitionBy("d", "t", "t2", *along).orderBy("at", "until")
    reach = F.max("until").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("until", F.col("at") + F.col("x") - 1).withColumn("fresh", F.coalesce((F.col("at") > reach + 1).cast("int"), F.lit(1)))
    islands = marked.withColumn("island", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy("d", "t", "t2", *along, "island").agg(F.min("at").alias("at"), F.max("until").alias("until"), *[F.min(c).alias(c) for c in ("begin", "first") if c in later.columns]).drop("island")


def _stretched(runs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Runs (begin, x, first, room: lines of the document before begin) made as long as both copies agree, each within its document: first to the right, then to the left, by falling powers of two. Ranks at a depth are equal where so many lines are."""
    for side in ("right", "left"):
        for k in range(len(levels) - 1, -1, -1):
            step = 1 << k
            here, there = ("begin + x", "first + x") if side == "right" else (f"begin - {step}", f"first - {step}")
            asked = runs.withColumn("_here", F.expr(here)).withColumn("_there", F.expr(there))
            asked = asked.join(levels[k].toDF("_here", "_r1"), "_here", "left").join(levels[k].toDF("_there", "_r2"), "_there", "left")
            # to the right ranks end at both documents' ends, but the lines from begin + x on may be another document's
            free = (F.col("x") + step <= F.least("after", "first_after")) if side == "right" else (F.col("room") >= step) & (F.col("first_room") >= step)
            more = F.coalesce((F.col("_r1") == F.col("_r2")) & free, F.lit(False))
            grown = {"x": F.when(more, F.col("x") + step).otherwise(F.col("x"))}
            if side == "left":
                less = lambda c: F.when(more, F.col(c) - step).otherwise(F.col(c))  # noqa: B023, E731
                grown |= {c: less(c) for c in ("begin", "first", "room", "first_room")}
                grown |= {c: F.when(more, F.col(c) + step).otherwise(F.col(c)) for c in ("after", "first_after")}
            runs = materialize(asked.withColumns(grown).drop("_here", "_there", "_r1", "_r2"), "stretched")
    return runs


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Maximal repeated runs of ``docs`` (doc_id, text): doc_id, from_line, to_line (as the text counts them, from 0), n_lines (with words), n_words, and where the other copy is, which comes before it: first_doc_id, first_line.

    A run and its other copy each lie within one document and can't be made longer at either end; no run lies within
    another one of its document with the same or another copy; together they cover the lines that dedup_lines()
    deletes. The other copy is the first one of a part of the run. Rows equal in doc_id and text are one document; a
    null doc_id comes back as null; an empty table, and texts without repeats, give no rows.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").alias("_text"))
    levels: list[DataFrame] = []
    lines, later = _later_copies(named, min_words, levels)
    last = (1 << 63) - 1
    doc = lambda c: F.when(F.col(c) != last, F.col(c))
    if later is None:
        return lines.limit(0).select(doc("d").alias("doc_id"), F.col("line").alias("from_line"), F.col("line").alias("to_line"), F.col("at").alias("n_lines"), F.col("at").alias("n_words"), doc("d").alias("first_doc_id"), F.col("line").alias("first_line"))
    there = lines.select(F.col("pos").alias("first"), (F.col("at") - 1).alias("first_room"), (F.col("count") - F.col("at") + 1).alias("first_after"))
    here = lines.select(F.col("pos").alias("begin"), (F.col("at") - 1).alias("room"), (F.col("count") - F.col("at") + 1).alias("after"))
    # one diagonal is one distance of positions, and one other document: where that begins
    placed = later.join(there, "first").withColumn("shift", F.col("begin") - F.col("first")).withColumn("other", F.col("first") - F.col("first_room"))
    joined = _joined(placed, "shift", "other").select("begin", (F.col("until") - F.col("at") + 1).cast("long").alias("x"), "first")
    long = _stretched(materialize(joined.join(here, "begin").join(there, "first"), "joined-runs"), levels)
    own = Window.partitionBy("document").orderBy("begin", F.desc("x"), "first")
    spans = long.select("begin", "x", "first", (F.col("begin") - F.col("room")).alias("document"), (F.col("begin") + F.col("x")).alias("stop"))
    outside = spans.withColumn("reach", F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("reach").isNull() | (F.col("stop") > F.col("reach")))
    runs = materialize(outside.withColumn("end", F.col("stop") - 1), "maximal-runs")
    at = lambda key, *cols: lines.select(F.col("pos").alias(key), *cols)
    found = runs.join(at("begin", "d", F.col("line").alias("from_line"), F.col("before").alias("_b")), "begin").join(at("end", F.col("line").alias("to_line"), F.col("upto").alias("_u")), "end").join(at("first", F.col("d").alias("_fd"), F.col("line").alias("first_line")), "first")
    return found.select(doc("d").alias("doc_id"), "from_line", "to_line", F.col("x").alias("n_lines"), (F.col("_u") - F.col("_b")).alias("n_words"), doc("_fd").alias("first_doc_id"), "first_line")


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, t2, line): the lines that documents lose."""
    lines, later = _later_copies(docs, min_words)
    if later is None:
        return lines.select("d", "t", "t2", "line").limit(0)
    gone = _joined(later.select("d", "t", "t2", "at", "x")).select("d", "t", "t2", F.explode(F.expr("sequence(at, until)")).alias("at"))
    return gone.join(lines.select("d", "t", "t2", "at", "line"), ["d", "t", "t2", "at"]).drop("at")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, which has doc_id and text, without text), text with later copies of repeated runs cut out, and how many lines there were and went: n_lines, n_deleted."""
    h1, h2 = fingerprint(F.col("text"))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    gone = deleted_lines(docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").alias("_text")), min_words)
    # which lines go, as one flag a line up to the last that goes: a column of its own, so that a text is split once and no list is searched
    own = Window.partitionBy("d", "t", "t2").orderBy("line")
    gaps = gone.withColumn("gap", F.col("line") - F.coalesce(F.lag("line").over(own), F.lit(-1)) - 1)
    flags = gaps.groupBy("d", "t", "t2").agg(F.sort_array(F.collect_list(F.struct("line", "gap"))).alias("cut"))
    flags = materialize(flags.select("d", "t", "t2", F.flatten(F.transform("cut", lambda c: F.concat(F.array_repeat(F.lit(False), c["gap"]), F.array(F.lit(True))))).alias("flags"), F.size("cut").alias("n")), "gone")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").alias("text"), doc.alias("d"), h1.alias("t"), h2.alias("t2"))
    # the plan is the same at every size: text is shuffled once, never held against a broadcast table
    joined = keyed.join(flags.hint("merge"), ["d", "t", "t2"], "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.coalesce(F.get("flags", i), F.lit(False)))
    text = F.when(F.col("flags").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(0))
    return joined.select("row", text.alias("text"), n_lines.cast("long").alias("n_lines"), F.coalesce("n", F.lit(0)).cast("long").alias("n_deleted"))


def op4_line_runs(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "text", "n_lines", "n_deleted")


#: The same by text: runs are the joined lines themselves.
ORACLE = """
WITH RECURSIVE numbered AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, i - 1 AS line, regexp_replace(ls[i], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS raw
  FROM numbered, unnest(range(1, len(ls) + 1)) AS u(i)
), w AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS nr,
         len(regexp_split_to_array(raw, '[\\x20\\x09-\\x0D]+')) AS n
  FROM lines WHERE raw <> ''
), s AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY nr) AS upto FROM w
), runs AS (
  SELECT a.doc_id, a.nr AS b, min(z.nr) AS e FROM s a JOIN s z ON a.doc_id = z.doc_id AND z.nr >= a.nr AND z.upto - a.upto + a.n >= 50 GROUP BY 1, 2
  UNION
  SELECT z.doc_id, max(a.nr), z.nr FROM s a JOIN s z ON a.doc_id = z.doc_id AND z.nr >= a.nr AND z.upto - a.upto + a.n >= 50 GROUP BY 1, z.nr
), spelled AS (
  SELECT r.doc_id, r.b, r.e, string_agg(s.raw, chr(10) ORDER BY s.nr) AS words FROM runs r JOIN s ON s.doc_id = r.doc_id AND s.nr BETWEEN r.b AND r.e GROUP BY 1, 2, 3
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY words ORDER BY doc_id, b) AS k FROM spelled) WHERE k > 1
), gone AS (
  SELECT DISTINCT s.doc_id, s.line FROM later l JOIN s ON s.doc_id = l.doc_id AND s.nr BETWEEN l.b AND l.e
), g AS (
  SELECT doc_id, list(line) AS cut FROM gone GROUP BY 1
)
SELECT doc_id,
       CASE WHEN cut IS NULL THEN text ELSE coalesce(array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(cut, i - 1)], chr(10)), '') END AS text,
       len(ls)::BIGINT AS n_lines, coalesce(len(cut), 0)::BIGINT AS n_deleted
FROM numbered LEFT JOIN g USING (doc_id)
"""
