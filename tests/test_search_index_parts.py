"""Postings in parts, one a batch, and several queries at once, against the scan."""

import random

import pyarrow as pa
import pytest

from tests.test_search_index import QUERIES, corpus  # noqa: F401
from tidemark.operators import search, search_index


def test_queries_at_once_find_what_scans_find(spark, corpus):  # noqa: F811
    df, folder = corpus
    for queries in ([q for q in QUERIES if q], QUERIES, ["", " "]):
        got = sorted((r["query"], r["id"]) for r in search_index.search_all(spark, folder, queries).select("query", "row.id").collect())
        assert got == sorted((q, r["id"]) for q in queries for r in df.where(search.matches(q)).select("id").collect())


def test_sessions_are_read_once_for_all_queries(spark, corpus):  # noqa: F811
    plan = search_index.search_all(spark, corpus[1], ["claude", "bash", "f"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row#") and sum("Relation" in line and "row#" in line for line in plan.splitlines()) == 1


@pytest.mark.parametrize("held", [1, 50])
def test_parts_of_postings_are_put_together(spark, tmp_path, monkeypatch, held):
    rng = random.Random(4)
    texts = [None if k % 17 == 0 else "".join(rng.choice("abé😀\x00 ") for _ in range(rng.randint(0, 30))) for k in range(300)]
    block, at = [k // 128 for k in range(300)], [k % 128 for k in range(300)]
    monkeypatch.setattr(search_index, "HELD", held)
    order = rng.sample(range(300), 300)
    batch = pa.record_batch([pa.array([block[k] for k in order], pa.int64()), pa.array([at[k] for k in order], pa.int32()), pa.array([[t for t in (texts[k], "same") if t] for k in order], pa.list_(pa.string()))], names=["_block", "at", "texts"])
    got = {}
    for part in search_index._cut([batch]):
        for r in part.to_pylist():
            assert r["places"] == sorted(set(r["places"]))
            got.setdefault((r["run"], r["_block"]), []).extend(r["places"])
    want = {}
    for k in range(300):
        for t in (texts[k], "same"):
            for i in range(len(t or "")):
                want.setdefault(((t + "\x01\x01")[i : i + 3], block[k]), set()).add(at[k])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
