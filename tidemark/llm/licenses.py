"""License scans by diagonal voting (operator 13). DataFrame operations only.

Every word k-gram of every document is joined by its hash to the k-grams of templates: short phrases and longer license
texts. A hit at document position d and template position t votes for the diagonal d - t. A phrase stands where all of
its k-grams vote for one diagonal, at that place. A longer text may be edited: words put in or left out move the rest of
a copy to a neighbouring diagonal, so diagonals no further apart than GAP (and than a quarter of the template) are
merged, and the merged span is verified: it has to hold at least MIN_SHARE of the template's k-grams, each counted once,
within at most MAX_STRETCH times the template's words. A single diagonal is verified by the same rule, so a copy that
noise ties to a distant diagonal is still found. Hits are held against the words themselves, so a hash collision makes no
hit. ``score`` is the greatest verified share of a document (a phrase's is 1), 0 if nothing is found.

Templates are bounded by MAX_TEMPLATE_WORDS in all, checked, so their k-grams may be sent to all tasks; documents are read
once and only hits move, by row and template, so common phrases and copies of documents load no key. Each row has a
number that is written with its hits, so rows need no id.

Results defined for odd input: a null or empty text has no words (n_words 0, no places, labels empty strings, score 0);
rows with equal or null doc_id are rows of their own; texts are scanned whole, of any length, as one list of words;
phrases that overlap or share a place count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

# The phrases and labels of the base rules.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
# Public license texts and notices that the method looks for beside the phrases.
TEXTS = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Words a k-gram; words between neighbouring diagonals that are merged; the least share and the greatest stretch of a verified span.
K, GAP, MIN_SHARE, MAX_STRETCH = 3, 8, 0.8, 1.5
#: Words of all templates together, so that sending them to all tasks is bounded.
MAX_TEMPLATE_WORDS = 20_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = "".join(map(chr, [*range(0x00, 0x20), *range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case: what stands between characters of ASCII that are neither letters nor digits."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER + _BREAKS, _UPPER.lower() + " " * len(_BREAKS)), " "), "")


def _grams(w: Column, k: int) -> Column:
    """As many entries as words; those that have no k words from there on end in nulls."""
    return F.arrays_zip(w.alias("w0"), *[F.slice(w, j + 1, F.greatest(F.size(w), F.lit(1))).alias(f"w{j}") for j in range(1, k)])


def templates(spark, phrases: list[tuple[str, str]], texts: list[tuple[str, str]], k: int) -> DataFrame:
    """template, label, base, n_grams, n_template, t, h and the k words g0, g1, ...: a row for each k-gram of each template."""
    rows = spark.createDataFrame([(i, label, i < len(phrases), text) for i, (label, text) in enumerate([*phrases, *texts])], "template int, label string, base boolean, text string")
    cut = rows.select("template", "label", "base", words(F.col("text")).alias("w"))
    size, shortest = cut.agg(F.sum(F.size("w")), F.min(F.size("w"))).first()
    if size is not None and (size > MAX_TEMPLATE_WORDS or shortest < k):
        raise ValueError(f"templates need {k} words each and {MAX_TEMPLATE_WORDS} together at most")
    cut = cut.withColumn("n_template", F.size("w")).withColumn("n_grams", F.size("w") - (k - 1))
    cut = cut.select("template", "label", "base", "n_template", "n_grams", F.posexplode(_grams(F.col("w"), k)).alias("t", "g")).where(F.col("t") < F.col("n_grams"))
    cut = cut.select("*", *[F.col(f"g.{name}").alias(f"g{j}") for j, name in enumerate(cut.schema["g"].dataType.names)])
    return cut.drop("g").withColumn("h", F.xxhash64(*[f"g{j}" for j in range(k)]))


def hits(docs: DataFrame, table: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, doc_id, n_words, d, and for a hit template, label, base, n_template, n_grams and t: the hits, and for each document a row at least."""
    cut = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
    every = cut.select("rid", "doc_id", F.size("w").alias("n_words"), F.posexplode_outer(_grams(F.col("w"), k)).alias("d", "g"))
    names = every.schema["g"].dataType.names
    every = every.select("rid", "doc_id", "n_words", "d", *[F.col(f"g.{name}").alias(f"v{j}") for j, name in enumerate(names)])
    every = every.withColumn("v", F.when(F.col(f"v{k - 1}").isNotNull(), F.xxhash64(*[f"v{j}" for j in range(k)])))
    same = F.col("v") == F.col("h")
    for j in range(k):
        same = same & (F.col(f"v{j}") == F.col(f"g{j}"))
    found = every.join(F.broadcast(table), same, "left").where(F.col("t").isNotNull() | F.col("d").isNull() | (F.col("d") == 0))
    return found.select("rid", "doc_id", "n_words", F.col("d").cast("long").alias("d"), "template", "label", "base", "n_template", "n_grams", "t")


def diagonals(found: DataFrame) -> DataFrame:
    """rid, template, diagonal and the template positions that vote for it, with the template's columns; a diagonal has no more of them than the template has k-grams."""
    keys = ["rid", "template", "label", "base", "n_template", "n_grams", "diagonal"]
    return found.where(F.col("t").isNotNull()).withColumn("diagonal", F.col("d") - F.col("t")).groupBy(*keys).agg(F.collect_set("t").alias("ts"))


def _verified(spans: DataFrame, k: int) -> DataFrame:
    """Spans that hold enough of their template without being stretched, with their shares."""
    share = F.col("covered") / F.col("n_grams")
    return spans.where((share >= MIN_SHARE) & (F.col("stop") - F.col("start") <= F.col("n_template") * MAX_STRETCH)).withColumn("share", share)


def spans(votes: DataFrame, k: int) -> DataFrame:
    """rid, template, label, start, stop and share of verified spans of the longer texts: merged diagonals, and single ones."""
    keys = ["rid", "template", "label", "n_template", "n_grams"]
    mine = votes.where(~F.col("base")).drop("base")
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > F.least(F.lit(GAP), F.floor(F.col("n_template") / 4))
    joined = mine.withColumn("new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = joined.select(*keys, "part", "diagonal", F.explode("ts").alias("t"))
    at = each.groupBy(*keys, "part", "t").agg(F.min(F.col("diagonal") + F.col("t")).alias("start"), F.max(F.col("diagonal") + F.col("t") + k).alias("stop"))
    merged = at.groupBy(*keys, "part").agg(F.count("*").alias("covered"), F.min("start").alias("start"), F.max("stop").alias("stop")).drop("part")
    single = mine.select(*keys, F.size("ts").cast("long").alias("covered"), (F.col("diagonal") + F.array_min("ts")).alias("start"), (F.col("diagonal") + F.array_max("ts") + k).alias("stop"))
    return _verified(merged.unionByName(single), k).select("rid", "template", "label", "start", "stop", "share").distinct()


def places(votes: DataFrame) -> DataFrame:
    """rid, label and start of each place of a phrase: a diagonal that all of its k-grams vote for."""
    return votes.where(F.col("base") & (F.size("ts") == F.col("n_grams"))).select("rid", "label", F.col("diagonal").alias("start"))


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, texts: list[tuple[str, str]] = TEXTS, k: int = K, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row."""
    found = materialize(hits(docs, templates(docs.sparkSession, phrases, texts, k), k, doc_id, text), "license-hits")
    votes = diagonals(found)
    kind = found.schema["doc_id"].dataType
    none = lambda t: F.lit(None).cast(t)
    rows = found.where(F.col("d").isNull() | (F.col("d") == 0)).select("rid", F.struct("doc_id", "n_words").alias("head"), none("long").alias("start"), none("string").alias("base_label"), none("string").alias("label"), F.lit(0.0).alias("share"))
    base = places(votes).select("rid", none(rows.schema["head"].dataType).alias("head"), "start", F.col("label").alias("base_label"), "label", F.lit(1.0).alias("share"))
    more = spans(votes, k).select("rid", none(rows.schema["head"].dataType).alias("head"), none("long").alias("start"), none("string").alias("base_label"), "label", "share")
    together = rows.unionByName(base).unionByName(more).groupBy("rid").agg(
        F.any_value("head", True).alias("head"), F.count("start").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"),
        F.collect_set("base_label").alias("base_labels"), F.collect_set("label").alias("labels"), F.max("share").alias("score"),
    )
    one = lambda c: F.array_join(F.array_sort(c), ",")
    return together.select(F.col("head.doc_id").cast(kind).alias("doc_id"), F.col("head.n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", one("base_labels").alias("base_labels"), one("labels").alias("labels"), "score")


def op13_diagonal_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same definition in SQL, with k-grams as lists of words instead of hashes."""
    values = ", ".join(f"({i}, '{label}', {i < len(PHRASES)}, '{text}')" for i, (label, text) in enumerate([*PHRASES, *TEXTS]))
    cut = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH t AS (SELECT template, label, base, {cut} AS w FROM (VALUES {values}) v(template, label, base, text)),
tg AS (SELECT template, label, base, len(w) AS n_template, len(w) - {K - 1} AS n_grams, i AS t, w[i + 1 : i + {K}] AS g FROM (SELECT *, unnest(range(len(w) - {K - 1})) AS i FROM t)),
doc AS (SELECT row_number() OVER () AS rid, doc_id, {cut} AS w FROM documents),
hits AS (SELECT rid, d - t AS diagonal, tg.* EXCLUDE (g) FROM (SELECT rid, i AS d, w[i + 1 : i + {K}] AS g FROM (SELECT *, unnest(range(len(w) - {K - 1})) AS i FROM doc)) JOIN tg USING (g)),
votes AS (SELECT rid, template, label, base, n_template, n_grams, diagonal, list(DISTINCT t) AS ts FROM hits GROUP BY ALL),
places AS (SELECT rid, label, diagonal AS start FROM votes WHERE base AND len(ts) = n_grams),
cut AS (SELECT *, sum(new) OVER (PARTITION BY rid, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS part FROM (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= least({GAP}, n_template // 4) THEN 0 ELSE 1 END AS new FROM votes WHERE NOT base)),
single AS (SELECT rid, label, n_template, n_grams, len(ts) AS covered, diagonal + list_min(ts) AS start, diagonal + list_max(ts) + {K} AS stop FROM cut),
merged AS (SELECT rid, label, n_template, n_grams, count(DISTINCT t) AS covered, min(diagonal + t) AS start, max(diagonal + t + {K}) AS stop
  FROM (SELECT *, unnest(ts) AS t FROM cut) GROUP BY rid, template, label, n_template, n_grams, part),
spans AS (SELECT rid, label, covered / n_grams AS share FROM (SELECT * FROM single UNION ALL SELECT * FROM merged) WHERE covered / n_grams >= {MIN_SHARE} AND stop - start <= n_template * {MAX_STRETCH}),
b AS (SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY rid),
m AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT * FROM spans UNION ALL SELECT rid, label, 1 FROM places) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM doc LEFT JOIN b USING (rid) LEFT JOIN m USING (rid)"""


ORACLE = _oracle()
