"""State that ends, and state that doesn't grow."""

import datetime as dt

from tidemark.streaming import activity


def arrivals(spark, tmp_path, batches, schema):
    """A stream that brings one file at a time, in order."""
    for k, rows in enumerate(batches):
        folder = tmp_path / "in"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/w{k}")
        folder.mkdir(exist_ok=True)
        part = next((tmp_path / f"w{k}").glob("part-*.parquet"))
        target = folder / f"{k}.parquet"
        part.rename(target)
        import os

        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_sessions_that_never_complete_are_told_and_forgotten(spark, tmp_path):
    t = lambda h: dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)
    batches = [
        [(1, 3, 0.5, t(0)), (1, 3, 0.7, t(0)), (2, 2, 0.1, t(0)), (2, 2, 0.2, t(1))],
        [(3, 2, 0.3, t(10)), (4, 1, 0.9, t(10))],
        [(3, 2, 0.6, t(20)), (5, 5, 0.4, t(90))],
        [(6, 1, 0.0, t(200))],
    ]
    stream = arrivals(spark, tmp_path, batches, "session long, expected int, sim double, at timestamp")
    got = sorted(tuple(r) for r in activity.drain(activity.complete_or_expired(stream)).collect())
    assert got == [(1, 2, 0.7, False), (2, 2, 0.2, True), (3, 2, 0.6, True), (4, 1, 0.9, True), (5, 1, 0.4, False), (6, 1, 0.0, True)]
    # without expiry the whole ones are the same
    plain = sorted(tuple(r) for r in activity.drain(activity.complete_sessions(stream.drop("at"))).collect())
    assert plain == [r[:3] for r in got if r[3]]


def test_a_ring_keeps_the_last_events_of_a_key(spark, tmp_path):
    batches = [[("a", k, f"m{k}") for k in range(b * 40, b * 40 + 40)] + [("b", b, f"b{b}")] for b in range(4)]
    stream = arrivals(spark, tmp_path, batches, "source string, pos long, message string")
    seen = []
    query = activity.ring(stream, size=50).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(len(r["messages"]) for r in seen) == 50
    last = max((r for r in seen if r["source"] == "a"), key=lambda r: r["n"])
    assert (last["n"], last["messages"]) == (160, [f"m{k}" for k in range(110, 160)])
    assert max((r for r in seen if r["source"] == "b"), key=lambda r: r["n"])["messages"] == ["b0", "b1", "b2", "b3"]
