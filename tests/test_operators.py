"""Hand-computed cases of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, kernels, text
from tidemark.operators import cost, duplicates, lifecycle, merge, rollups, search, sessions, similarity, topics
from tidemark.schema import DAY_MS


def value(spark, column, **inputs):
    df = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in inputs.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("# Research Prompt — X\n\nYou are doing research only.", "research prompt — x you are doing research only."),
        ("see https://a.b/c?d now", "see now"),
        ("a ```code\nx``` b", "a b"),
        ("- one\n* two\n+ three", "one two three"),
        ("open src/a/b.ts and x/y.md", "open b.ts and y.md"),
        ("a/b.ts/c stays partly", "b.ts/c stays partly"),
        ("nbsp\u00a0 here \u3000", "nbsp here"),
        ("", ""),
    ],
)
def test_normalize_for_hash(spark, raw, want):
    assert value(spark, text.normalize_for_hash(F.col("c")), c=raw) == want


def test_normalize_cuts_and_keeps_order(spark):
    assert len(value(spark, text.normalize_for_hash(F.col("c")), c="x " * 500)) == 400


@pytest.mark.parametrize(("raw", "want"), [("/a/b/c/", "c"), ("C:\\x\\y", "y"), ("/", None), ("bare", "bare"), ("  /a/b  ", "b"), ("", None)])
def test_basename(spark, raw, want):
    assert value(spark, text.basename(F.col("c")), c=raw) == want


def test_clip_ellipsis_preview_title(spark):
    assert value(spark, text.clip(F.col("c"), 3), c="ab  cdef") == "ab …(+4 chars)"
    assert value(spark, text.ellipsis(F.col("c"), 4), c="abcdef") == "abc…"
    assert value(spark, text.preview(F.col("c")), c=" \n\t ") is None
    assert value(spark, text.cut_title(F.col("c")), c="word " * 20) == "word word word word word word word word word…"
    assert value(spark, text.cut_title(F.col("c")), c="y" * 60) == "y" * 47 + "…"
    assert value(spark, text.cut_title(F.col("c")), c="short") == "short"


def test_tokens_keep_order_and_drop_stopwords(spark):
    assert value(spark, text.tokens(F.col("c")), c="The Spark engine, the SPARK plan of an ox") == ["spark", "engine", "plan"]


@pytest.mark.parametrize(("day", "want"), [(0, -4), (3, 3), (9, 3), (10, 10), (-4, -4), (-5, -11)])
def test_week_start_is_sunday_also_before_1970(spark, day, want):
    assert value(spark, dates.week_start(F.col("c")), c=day * DAY_MS) == want * DAY_MS


def test_parse_ms(spark):
    assert value(spark, dates.parse_ms(F.col("c")), c="2024-01-01T00:00:00.250Z") == 1704067200250
    assert value(spark, dates.parse_ms(F.col("c")), c="not a time") is None


@pytest.mark.parametrize(("age", "want"), [(30_000, "1m ago"), (7_200_000, "2h ago"), (2 * DAY_MS + 1, "2d ago"), (-5, "2001-08-02")])
def test_relative(spark, age, want):
    now = 996_710_400_000
    assert value(spark, dates.relative(now, F.col("c")), c=now - age) == want


PRICE = "id string, model string, models_used array<string>, total_cost_usd double, token_totals struct<input:bigint,output:bigint,cache_creation:bigint,cache_read:bigint>"


@pytest.mark.parametrize(
    ("row", "usd", "used", "note", "unknown"),
    [
        (("claude-opus-4-7", None, None, (478, 375328, 1505286, 28855031)), 99.663429, "claude-opus-4-7", None, None),
        (("claude-opus-4-7", None, None, (796, 110758, 255965, 7865996)), 24.91712775, "claude-opus-4-7", None, None),
        (("claude-opus-4-6", None, None, (2081, 17966, 129601, 696364)), 4.85322975, "claude-opus-4-6", None, None),
        (("x", None, 149.11316735, (1, 1, 1, 1)), 149.11316735, None, None, None),
        (("nobody", None, None, (1000, 1000, 0, 0)), None, None, None, "nobody"),
        ((None, None, None, (1_000_000, 0, 0, 0)), 15.0, "claude-opus-4-6", "assumed_model", None),
        ((None, ["claude-haiku-4-5", "claude-opus-4-7"], None, (0, 1_000_000, 0, 0)), 75.0, "claude-opus-4-7", "cost-weighted model selection", None),
        (("claude-opus-4-6", ["claude-opus-4-7", "claude-opus-4-6"], None, (0, 0, 0, 0)), 0.0, "claude-opus-4-6", "cost-weighted model selection", None),
        (("b", ["a", "b"], None, (1, 1, 1, 1)), None, None, None, "a"),
        (("claude-opus-4-7", None, None, None), None, None, None, None),
    ],
)
def test_price(spark, row, usd, used, note, unknown):
    got = cost.price(spark.createDataFrame([("s", *row)], PRICE)).first()
    assert got["cost_estimated_usd"] == (None if usd is None else pytest.approx(usd, abs=1e-9))
    assert (got["cost_breakdown"]["model_id_used"] if got["cost_breakdown"] else None) == used
    assert (got["cost_breakdown"]["note"] if got["cost_breakdown"] else None) == note
    assert got["unknown_model"] == unknown


def test_exact_clusters(spark):
    long = "this text is certainly longer than forty characters"
    rows = [("a1", f"B {long}", 0), ("b1", long, 1), ("b2", long.upper(), 2), ("a2", f"b  {long}", 3), ("b3", long, 4), ("x", "short", 5), ("y", None, 6), ("z", f"{long} alone", 7)]
    df = spark.createDataFrame(rows, "id string, first_human_text string, pos int")
    got = [(r["size"], r["session_ids"]) for r in duplicates.ordered(duplicates.exact_clusters(df)).collect()]
    assert got == [(3, ["b1", "b2", "b3"]), (2, ["a1", "a2"])]
    assert duplicates.exact_clusters(df.limit(0)).count() == 0


CLUSTERS = "cluster_id string, pos int, session_ids array<string>"


@pytest.mark.parametrize(
    ("exact", "semantic", "want"),
    [
        ([("e", 0, ["a", "b"])], [], {("exact", "e", "ab")}),
        ([("e", 0, ["a", "b"])], [("s", 0, ["b", "c"])], {("exact+semantic", "e", "abc")}),
        ([("e", 0, ["a", "b"])], [("s", 0, ["c", "d"])], {("exact", "e", "ab"), ("semantic", "s", "cd")}),
        ([("e", 0, ["a", "b"]), ("f", 1, ["c", "d"])], [("s", 0, ["b", "c"])], {("exact+semantic", "e", "abcd")}),
        ([("e", 0, ["a", "b"]), ("f", 1, ["b", "c"])], [], {("exact", "e", "ab"), ("exact", "f", "bc")}),
    ],
)
def test_merged_clusters(spark, exact, semantic, want):
    got = duplicates.merged_clusters(spark.createDataFrame(exact, CLUSTERS), spark.createDataFrame(semantic, CLUSTERS))
    assert {(r["kind"], r["representative"], "".join(r["session_ids"])) for r in got.collect()} == want


LIFE = "project string, started_at bigint, updated_at bigint, title string, preview string, pos int"


def day(p, *starts, titles=None):
    return [(p, s * DAY_MS, s * DAY_MS, (titles or {}).get(s, "work"), None, i) for i, s in enumerate(starts)]


def test_lifecycle(spark):
    rows = day("on", 980, 990) + day("asked", 700, 900, titles={900: "Is it still worth it"}) + day("busy", 700, 900, 905, 910, titles={900: "revisit"}) + day("silent", 100) + day("resting", 900)
    df = spark.createDataFrame(rows, LIFE)
    got = {r["project"]: (r["classification"], r["probes"]) for r in lifecycle.classify(df, 1000 * DAY_MS).collect()}
    assert got == {"on": ("active", 0), "asked": ("zombie", 1), "busy": ("dormant", 0), "silent": ("zombie", 0), "resting": ("dormant", 0)}
    assert [r["projects"] for r in lifecycle.class_counts(lifecycle.classify(df, 1000 * DAY_MS)).orderBy("classification").collect()] == [1, 2, 2]


def test_bursts_are_greedy_and_disjoint(spark):
    df = spark.createDataFrame(day("p", 0, 7, 14, 15, 20, 21, 60) + day("tie", 5, 5, 5), LIFE)
    got = sorted((r["project"], r["start"] // DAY_MS, r["end"] // DAY_MS, r["n"]) for r in lifecycle.bursts(df).collect())
    assert got == [("p", 0, 14, 3), ("p", 15, 21, 3), ("tie", 5, 5, 3)]


def test_search_is_literal_and_looks_at_tools_and_models(spark):
    schema = "id int, title string, summary string, preview string, cwd string, project string, top_tools map<string,bigint>, models_used array<string>"
    rows = [(1, "50% done", None, None, None, None, None, None), (2, "x", None, None, None, None, {"Bash": 1}, None), (3, "x", None, None, None, None, None, ["Opus"]), (4, "50x done", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    ids = lambda q: [r["id"] for r in df.where(search.matches(q)).orderBy("id").collect()]
    assert (ids("50%"), ids(" BASH "), ids("opus"), ids("")) == ([1], [2], [3], [1, 2, 3, 4])


def test_untagged_projects_sort_first(spark):
    df = spark.createDataFrame([("Zed", 1, 1), (None, 1, 2), ("apple", 1, 3)], "project string, updated_at bigint, pos int")
    assert [r["project"] for r in search.page(df, "project").collect()] == [None, "apple", "Zed"]


def test_project_match_prefers_title_then_list_order(spark):
    patterns = sessions.project_patterns([("1", "Alpha one"), ("2", "design"), ("3", "abcd"), ("4", "c++ kit"), ("5", "Beta two")])
    assert [n for n, _ in patterns] == ["Alpha one", "c++ kit", "Beta two"]
    df = spark.createDataFrame([("on beta TWO", "alpha one"), ("none", "see Alpha One."), ("xalpha one", ""), ("the c++ kit!", "")], "t string, s string")
    assert [r["m"] for r in df.select(sessions.match_project(F.col("t"), F.col("s"), patterns).alias("m")).collect()] == ["Beta two", "Alpha one", None, "c++ kit"]


def test_word_boundary_is_ascii(spark):
    assert value(spark, F.col("c").rlike(text.word_pattern("caf")), c="café") is True


def test_merges_are_idempotent(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, updated_at bigint, body string")
    once = merge.merge_uploads(df, df)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, df.collect()))


def test_validation_and_source_counts(spark):
    df = spark.createDataFrame([("a", "cloud", None)], "id string, source string, title string")
    assert [tuple(r) for r in merge.validation_errors(df, ["id", "title"]).collect()] == [("cloud", "a", "title")]
    assert {r["source"]: r["n"] for r in rollups.source_counts(df).collect()} == {"cloud": 1, "cowork": 0, "cli-direct": 0, "cli-desktop": 0}


def test_weeks_are_dense(spark):
    df = spark.createDataFrame([(3 * DAY_MS,), (24 * DAY_MS,)], "updated_at bigint")
    assert [r["n"] for r in rollups.weekly(df).orderBy("week").collect()] == [1, 0, 0, 1]
    assert rollups.weekly(df.limit(0)).count() == 0


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, vec array<float>")


@pytest.mark.parametrize(("vec", "want"), [([1.0, 0.0], "a"), ([0.3, 0.2], None), ([0.71, 0.70], None)])
def test_nearest_abstains(spark, vec, want):
    centroids = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0])], "centroid_id string, ord int, vec array<float>")
    assert similarity.nearest(_vectors(spark, [(1, vec)]), centroids, 0.4, 0.02).first()["label"] == want


def test_single_centroid_needs_no_margin(spark):
    centroids = spark.createDataFrame([("a", 0, [1.0, 0.0])], "centroid_id string, ord int, vec array<float>")
    assert similarity.nearest(_vectors(spark, [(1, [0.5, 0.1])]), centroids, 0.4, 0.02).first()["label"] == "a"


def test_mean_pool_of_opposites_is_null(spark):
    got = {r["doc_id"]: r["vec"] for r in similarity.mean_pool(_vectors(spark, [(1, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [3.0, 4.0])])).collect()}
    assert got[1] is None
    assert got[2] == pytest.approx([0.6, 0.8])


def _slow_linkage(s, t):
    groups = [[i] for i in range(len(s))]
    while True:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                low = min(s[a, b] for a in groups[i] for b in groups[j])
                if low >= t and (best is None or low > best[0]):
                    best = (low, i, j)
        if best is None:
            return groups
        groups[best[1]] += groups.pop(best[2])


@pytest.mark.parametrize("seed", range(8))
def test_linkage_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(24, 3))
    if seed % 2:
        x = np.round(x)  # ties
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    s = (x @ x.T).astype(np.float32)
    assert [sorted(g) for g in topics.linkage(s, 0.6)] == [sorted(g) for g in _slow_linkage(s, np.float32(0.6))]


def test_complete_linkage_does_not_chain(spark):
    angles = [0, 35, 70, 105]
    rows = [(i, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]) for i, a in enumerate(angles)]
    got = topics.complete_linkage(spark.createDataFrame(rows, "pos int, vec array<float>"), 0.8)
    assert {tuple(r) for r in got.collect()} == {(0, 0), (1, 0), (2, 2), (3, 2)}


@pytest.mark.parametrize("most", [5_000, 3])
def test_complete_linkage_of_components_of_any_size(spark, monkeypatch, most):
    """In one task and in rounds over pairs the clusters are those of one matrix; copies of a vector stay together."""
    monkeypatch.setattr(topics, "MOST_LINKED", most)
    monkeypatch.setattr(similarity, "BLOCK", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.vstack([x, x[:5]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["pos"]: r["cluster"] for r in topics.complete_linkage(spark.createDataFrame(rows, "pos int, vec array<float>"), 0.5).collect()}
    unique = x[:40].astype(np.float64)
    want = {}
    for g in topics.linkage(unique @ unique.T, 0.5):
        want |= dict.fromkeys(g, min(g))
    assert got == want | {40 + i: want[i] for i in range(5)}


def test_normaliser_steps(spark):
    """Fences, links, list and heading marks, directories and every kind of white space."""
    cases = {
        "# Title\n- item\n* star": "title item star", "see https://a.b/c?d now": "see now", "a ```x\ny``` b": "a b", "open src/lib/main.py please": "open main.py please",
        "\u00a0a\u2003b\ufeff": "a b", "x\u2028## y\r- z": "x y z", "A\x0bB\x0cC": "a b c", "x" * 500: "x" * 400, "": "", "dash - kept": "dash - kept",
    }
    for raw, want in cases.items():
        assert value(spark, text.normalize_for_hash(F.col("c")), c=raw) == want


def test_parse_clusters(spark):
    good = '{"id": "a", "hash": "h", "sessionIds": ["x", 3, "y"], "sampleText": "t"}'
    files = [(f'{{"clusters": [{good}, 4, {{"id": 1}}, {{"id": "b", "hash": "h", "sessionIds": "no", "sampleText": "t"}}]}}',), ("[1]",), ("{broken",), (None,), ('{"clusters": 3}',)]
    got = duplicates.parse_clusters(spark.createDataFrame(files, "value string")).collect()
    assert [(r["id"], r["hash"], r["session_ids"], r["sample_text"]) for r in got] == [("a", "h", ["x", "y"], "t")]


def test_formats(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], ["c"]).select(f(F.col("c"))).first()[0]
    assert [one(text.format_usd, v) for v in (0.0, 9.5, 999.99, 1234.0)] == ["$0.00", "$9.50", "$999.99", "$1.2k"]
    assert [one(text.format_count, v) for v in (7, 1500, 2_500_000)] == ["7", "1.5k", "2.5M"]
    assert [one(text.format_average, v) for v in (9.96, 10.4)] == ["10.0", "10"]
    assert one(text.inline_html, "<b> `x` **y** *z* [l](https://a.b)") == '&lt;b&gt; <code>x</code> <strong>y</strong> <em>z</em> <a href="https://a.b">l</a>'


def test_kmeans_labels_and_plane(spark):
    placed = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc int, cluster int")
    tokens = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["b", "c"]), (3, [])], "doc int, tokens array<string>")
    assert {tuple(r) for r in topics.kmeans_labels(placed, tokens, 2).collect()} == {(0, "b + a", 2), (1, "", 1)}
    flat = topics.plane(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "doc int, vec array<float>")).collect()
    assert all(len(r["at"]) == 2 and abs(r["at"][1]) < 1e-6 for r in flat)


def test_cluster_ids():
    assert kernels.fnv_id(["a", "bc"]) != kernels.fnv_id(["ab", "c"])
    assert kernels.fnv_id(["b", "a"]) == kernels.fnv_id(["a", "b"])
    assert kernels.fnv_id(["a"]) == f"cl-{((0x811C9DC5 ^ 0x61) * 0x01000193 & 0xFFFFFFFF ^ 0x7C) - (1 << 32):x}"


def test_chunks():
    assert kernels.chunk("t", "s", ["short"]) == ["t\ns", "short"]
    assert kernels.chunk(None, None, ["aa bb cc"], limit=5) == ["aa bb", "cc"]
    assert kernels.chunk(None, None, ["x" * 7], limit=3) == ["xxx", "xxx", "x"]
    assert kernels.chunk(None, None, [], "fallback") == ["fallback"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"type":"ai-title","aiTitle":"T"}', "T"),
        ('{"type":"user","message":{"content":"a  b"}}', "a b"),
        ('{"type":"assistant","message":{"content":[{"type":"text","text":"x"},{"type":"tool_use","name":"Bash","input":{"command":"ls"}}]}}', "x · Bash · ls"),
        ('{"type":"user","message":{"content":[{"type":"tool_result","is_error":true,"content":"no"}]}}', "error · no"),
        ('{"type":"file-history-snapshot","snapshot":{"trackedFileBackups":{"a":1}}}', "snapshot · 1 tracked file"),
        ("[1]", None),
        ("{", None),
    ],
)
def test_line_preview(raw, want):
    assert kernels.preview_line(raw) == want


def test_uploads_of_disjoint_ids(spark):
    side = lambda rows, name: spark.createDataFrame([(*r, name) for r in rows], "id int, updated_at int, side string")
    got = merge.merge_uploads(side([(1, 5), (2, 5), (3, 5)], "old"), side([(2, 6), (3, 4), (4, 1)], "new"))
    assert {(r["id"], r["side"]) for r in got.collect()} == {(1, "old"), (2, "new"), (3, "old"), (4, "new")}


def test_hybrid_labels_take_the_first_source_that_answers(spark):
    """Near centroids first; among 30 or more abstentions topics are found; who is left is rescued by words, or stays without a label."""
    def unit(*v):
        v = np.array(v, float)
        return (v / np.linalg.norm(v)).tolist()

    rows = [(i, i, unit(1, 0.01 * i, 0, 0), ["sql", "plan"]) for i in range(3)]  # near the centroid
    rows += [(10 + i, 10 + i, unit(0, 0, 1, 0.001 * i), ["garden", "rose", f"w{chr(97 + i % 20)}w"]) for i in range(30)]  # a topic of their own
    rows += [(50, 50, unit(0, 1, 0, -1), ["sql", "plan"]), (51, 51, unit(0, -1, 0, -1), ["alone", "words", "here"])]
    docs = spark.createDataFrame(rows, "pos int, doc int, vec array<double>, tokens array<string>").withColumn("text", F.lit(""))
    centroids = spark.createDataFrame([("db", 0, [1.0, 0.0, 0.0, 0.0])], "centroid_id string, ord int, vec array<double>")
    got = {r["doc"]: r["label"] for r in topics.hybrid_labels(docs, docs.select("doc", "vec"), centroids, 0.5).collect()}
    assert {got[i] for i in range(3)} == {"db"}
    topic = {got[10 + i] for i in range(30)}
    assert len(topic) == 1 and next(iter(topic)).startswith("~")
    assert got[50] == "db" and got[51] is None
    few = docs.where("doc < 3 OR doc > 45")
    assert {r["doc"]: r["label"] for r in topics.hybrid_labels(few, few.select("doc", "vec"), centroids, 0.5).collect()} == {0: "db", 1: "db", 2: "db", 50: "db", 51: None}


def test_rescue_and_coherence(spark):
    tokens = spark.createDataFrame([(1, ["spark", "plan"]), (2, ["spark", "join"]), (3, ["cat"]), (4, [])], "doc int, tokens array<string>")
    labels = spark.createDataFrame([(1, None), (2, "sql"), (3, None), (4, None)], "doc int, label string")
    clusters = spark.createDataFrame([("sql", 0, ["spark", "join"])], "label string, ord int, tokens array<string>")
    assert {r["doc"]: r["label"] for r in topics.rescue(labels, tokens, clusters, 0.1).collect()} == {1: "sql", 2: "sql", 3: None, 4: None}
    terms = spark.createDataFrame([("c", "spark", 1), ("c", "join", 2), ("d", "cat", 1)], "cluster string, token string, rank int")
    got = topics.coherence(terms, tokens).collect()
    assert [(r["cluster"], round(r["coherence"], 6)) for r in got] == [("c", round(float(np.log(2)), 6))]


def test_kmeans_labels_shuffle_no_row_a_document_and_token(spark):
    from tidemark.operators import topics

    placed = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "doc int, cluster string")
    tokens = spark.createDataFrame([(1, ["x", "y", "y"]), (1, ["y", "z"]), (2, ["x", "z"]), (3, ["y"]), (4, []), (5, ["q"])], "doc int, tokens array<string>")
    labels = topics.kmeans_labels(placed, tokens, 2)
    assert {r["cluster"]: (r["label"], r["size"]) for r in labels.collect()}["a"] == ("y + x", 3)
    assert {r["cluster"]: (r["label"], r["size"]) for r in labels.collect()}["b"] == ("", 1)
    import re

    grouped = re.findall(r"Aggregate \[([^\]]*)\]", labels._jdf.queryExecution().optimizedPlan().toString())
    assert grouped and not any("doc" in g and "token" in g for g in grouped)
