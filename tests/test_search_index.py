"""The index against the scan."""

import random

import pytest

from tidemark.operators import search, search_index


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé日😀 .%_\\") for _ in range(rng.randint(0, 12)))
    rows = [(f"s{k}", rng.choice((None, "", word(), "Common Title")), word(), rng.choice((None, word())), None, rng.choice((None, "Proj A")), rng.choice((None, {}, {"Bash": 1, word() or "x": 2})), rng.choice((None, [], ["claude-opus-4-6", word()]))) for k in range(400)]
    df = spark.createDataFrame(rows, "id string, title string, summary string, preview string, cwd string, project string, top_tools map<string, long>, models_used array<string>").repartition(5)
    folder = f"file://{tmp_path_factory.mktemp('index')}"
    search_index.write(df, folder)
    return df, folder


QUERIES = ["a", "é", "日b", "😀", "😀😀", "common", "COMMON TITLE", "n t", "proj a", "bash", "OPUS", "claude-opus-4-6", "%", "_\\", ".", "x" * 40, "common titleproj", "ab", "e ", "bcd", ""]


@pytest.mark.parametrize("query", QUERIES)
def test_index_finds_what_the_scan_finds(spark, corpus, query):
    df, folder = corpus
    want = sorted(r["id"] for r in df.where(search.matches(query)).collect())
    assert sorted(r["id"] for r in search_index.search(spark, folder, query).collect()) == want
    if query.strip():
        share = search_index.share_read(spark, folder, query)
        print(f"{query!r}: {len(want)} found, {share:.3f} read")
        assert len(want) / 400 <= share <= 1


def test_rare_queries_read_little_and_blocks_bound_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK_BITS", 4)
    df = spark.range(500).selectExpr("concat('session number ', id) AS title", "id")
    folder = f"file://{tmp_path}"
    search_index.write(df, folder, ("title",), None, None)
    postings = spark.read.parquet(f"{folder}/postings").collect()
    assert max(len(r["places"]) for r in postings) <= 16 and all(r["places"] == sorted(r["places"]) for r in postings)
    assert [r["id"] for r in search_index.search(spark, folder, "NUMBER 477", ("title",), None, None).collect()] == [477]
    assert search_index.share_read(spark, folder, "number 477") <= 0.01
    assert search_index.search(spark, folder, "session", ("title",), None, None).count() == 500


def test_an_empty_index(spark, tmp_path):
    search_index.write(spark.createDataFrame([("1", "t")], "id string, title string").where("id = 'x'"), f"file://{tmp_path}", ("title",), None, None)
    assert search_index.search(spark, f"file://{tmp_path}", "t", ("title",), None, None).count() == 0
