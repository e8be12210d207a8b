"""Raw files to sessions."""

import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sessions
from tidemark.sources import archives, json_lines, manifests, tables
from tidemark.streaming import activity

ID = "01234567-89ab-cdef-0123-456789abcdef"


@pytest.fixture
def root(tmp_path):
    d = tmp_path / "proj"
    d.mkdir()
    lines = [
        {"type": "progress", "timestamp": "2024-01-01T00:00:10Z"},
        {"type": "user", "cwd": "C:\\w\\app", "timestamp": "2024-01-01T00:00:05Z", "message": {"content": [{"type": "tool_result", "text": "skip"}, {"type": "text", "text": "  hello   there "}]}},
        "not json {",
        {"type": "assistant", "message": {"model": "m1", "usage": {"input_tokens": 5, "output_tokens": "7"}, "content": [{"type": "tool_use", "name": "Bash"}, {"type": "tool_use", "name": ""}]}},
        "",
        {"type": "assistant", "message": {"model": "m2[1m]", "usage": {"input_tokens": 2, "cache_read_input_tokens": 9}, "content": [{"type": "tool_use", "name": "Bash"}]}},
        {"type": "assistant", "message": {"model": "m1"}},
        {"type": "ai-title", "aiTitle": "first"},
        {"type": "ai-title", "aiTitle": "last"},
        {"type": "odd-type"},
        {"type": "user", "cwd": "later", "timestamp": "bad", "message": {"content": "second"}},
    ]
    (d / f"{ID}.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    (d / "other.jsonl").write_text("{}")
    (d / "sub").mkdir()
    (d / "sub" / f"{ID}.jsonl").write_text("{}")
    return str(tmp_path)


def test_transcripts(spark, root):
    lines = json_lines.transcripts(spark, root)
    assert lines.select("file_id").distinct().count() == 1
    assert lines.agg(F.max("line_no")).first()[0] == 11
    f = json_lines.fold_transcripts(lines).first()
    assert (f["user_turns"], f["assistant_turns"], f["malformed"], f["cwd"]) == (2, 3, 1, "C:\\w\\app")
    assert (f["min_ts"], f["max_ts"]) == (1704067205000, 1704067210000)
    assert (f["first_user_text"].strip(), f["model"], f["models_used"], f["ai_title"]) == ("hello   there", "m1", ["m1", "m2[1m]"], "last")
    assert tuple(f["token_totals"]) == (7, 0, 0, 9)
    assert f["top_tools"] == {"Bash": 2}
    assert [r["type"] for r in json_lines.unknown_line_types(lines).collect()] == ["odd-type"]


def test_transcript_sessions(spark, root):
    folds = json_lines.fold_transcripts(json_lines.transcripts(spark, root))
    s = sessions.from_transcripts(folds).first()
    assert (s["id"], s["title"], s["title_source"], s["project"], s["duration_ms"], s["preview"]) == (ID, "last", "ai-title", "app", 5000, "hello there")
    desktop = spark.createDataFrame([(ID, "local_1", "Given", "/x/y", "dm")], "cli_session_id string, id string, title string, cwd string, model string")
    s = sessions.from_transcripts(folds, desktop).first()
    assert (s["id"], s["source"], s["title"], s["project"], s["model"]) == ("local_1", "cli-desktop", "Given", "y", "m1")


def test_missing_root_is_empty(spark, tmp_path):
    assert json_lines.transcripts(spark, str(tmp_path / "none")).count() == 0


def test_strict_reader_refuses_non_objects(spark):
    df = spark.createDataFrame([("{}",), ("[1]",), ("  ",), ("{",)], "raw string")
    assert [r["malformed"] for r in json_lines.parse(df, strict_objects=True).collect()] == [False, True, True]


def test_manifests_and_audit(spark, tmp_path):
    d = tmp_path / ID / ID
    d.mkdir(parents=True)
    good = {"sessionId": "local_aa", "createdAt": 1000, "lastActivityAt": 500, "title": "T", "cwd": "/x", "model": "m", "initialMessage": "hi", "surprise": 1}
    (d / f"local_{ID}.json").write_text(json.dumps(good))
    (d / f"local_{ID[:-1]}0.json").write_text("{broken")
    (d / f"local_{ID[:-1]}1.json").write_text(json.dumps(good | {"createdAt": "1000"}))
    (d / "config.json").write_text("{}")
    found = manifests.read_manifests(spark, str(tmp_path))
    assert found.count() == 3
    ok = manifests.valid(found, manifests.COWORK_REQUIRED)
    assert [(r["id"], r["created_at"]) for r in ok.collect()] == [("aa", 1000)]
    assert manifests.valid(found, manifests.DESKTOP_REQUIRED).count() == 0
    assert [r["key"] for r in manifests.drift(found).collect()] == ["surprise"]
    result = lambda n, keys: {"type": "result", "duration_ms": n, "duration_api_ms": n, "num_turns": 1, "total_cost_usd": 0.1, "modelUsage": {k: {} for k in keys}}
    raw = [json.dumps(x) for x in ({"type": "user"}, {"type": "assistant"}, result(1000, ["z", "a"]), result(2000, ["a", "b"]))]
    lines = spark.createDataFrame([("local_aa", i, x) for i, x in enumerate(raw)] + [("none", 0, '{"type":"user"}')], "session_key string, line_no int, raw string")
    audit = {r["session_key"]: r for r in json_lines.fold_audit(lines).collect()}
    a = audit["local_aa"]
    assert (a["duration_ms"], a["num_turns"], round(a["total_cost_usd"], 9), a["last_result_model"], a["model_usage_keys"]) == (3000, 2, 0.2, "b", ["z", "a", "b"])
    assert audit["none"]["total_cost_usd"] is None
    s = sessions.from_cowork(ok, json_lines.fold_audit(lines)).first()
    assert (s["duration_ms"], s["model"], s["models_used"], s["user_turns"]) == (-500, "b", ["z", "a", "b"], 1)
    assert sessions.desktop_stubs(ok).first()["user_turns"] == 0


def test_cloud_export(spark, tmp_path):
    message = lambda sender, text=None, content=None: {"uuid": "u", "sender": sender, "text": text, "content": content}
    data = [
        {"uuid": "1", "name": "Alpha one notes", "summary": "", "created_at": "2024-01-02T00:00:00Z", "updated_at": "2024-01-01T00:00:00Z", "chat_messages": [message("human", "", [{"type": "text", "text": "first"}]), message("assistant", "x", [{"type": "tool_use", "name": "web"}, {"type": "tool_use", "name": "web"}]), message("other", "?")]},
        {"uuid": "2", "name": "", "summary": "Alpha one", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:01:00Z", "chat_messages": []},
        {"uuid": "3", "name": "x", "created_at": "when", "updated_at": "2024-01-01T00:01:00Z", "chat_messages": []},
    ]
    with zipfile.ZipFile(tmp_path / "data-2024.zip", "w") as z:
        z.writestr("conversations.json", json.dumps(data))
    time.sleep(0.02)
    (tmp_path / "unrelated.zip").write_bytes(b"")
    latest = archives.latest_export(spark, str(tmp_path))
    assert latest.endswith("data-2024.zip")
    archives.extract(str(tmp_path / "data-2024.zip"), str(tmp_path / "out"))
    conversations = archives.read_conversations(spark, str(tmp_path / "out" / "conversations.json"))
    got = {r["id"]: r for r in sessions.from_conversations(conversations, sessions.project_patterns([("p", "Alpha one")])).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"]["duration_ms"], got["1"]["user_turns"], got["1"]["assistant_turns"], got["1"]["preview"], got["1"]["project"], got["1"]["top_tools"]) == (0, 1, 1, "first", "Alpha one", {"web": 2})
    assert (got["2"]["title_source"], got["2"]["preview"], got["2"]["project"]) == ("fallback", "Alpha one", None)
    assert tuple(sessions.skipped(conversations).first()) == (2, 1)
    assert archives.read_projects(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(FileNotFoundError):
        archives.read_conversations(spark, str(tmp_path / "none.json"))
    (tmp_path / "object.json").write_text("{}")
    with pytest.raises(ValueError, match="no array"):
        archives.read_conversations(spark, str(tmp_path / "object.json"))


@pytest.mark.parametrize("name", ["../x", "/etc/x", "a/../../x", "C:\\x"])
def test_unsafe_archives_are_refused(tmp_path, name):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ok.txt", "1")
        z.writestr(name, "2")
    with pytest.raises(ValueError, match="unsafe"):
        archives.extract(str(tmp_path / "a.zip"), str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out" / "ok.txt")


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", "cloud"), ("b", "cowork")], "id string, source string")
    path = str(tmp_path / "s")
    tables.write_sessions(df, path)
    assert [r["id"] for r in tables.previous(spark, path, "cloud").collect()] == ["a"]
    assert tables.previous(spark, str(tmp_path / "none")) is None
    assert tables.one(spark.read.parquet(path), "cowork", "b").count() == 1
    assert tables.assert_shape(df).count() == 2
    with pytest.raises(Exception, match="bad record"):
        tables.assert_shape(df.withColumn("source", F.lit("x"))).collect()
    assert tables.manifest(df, 5).first()["counts"]["cli-direct"] == 0
    assert [r["present"] for r in tables.analysis_status(spark, str(tmp_path)).collect()] == [False] * 6
    assert [r["value"] for r in tables.csv_lines(spark.createDataFrame([("a,b", 'q"', None)], "x string, y string, z string")).collect()] == ['"a,b","q""",']


def test_streams_equal_batches_and_sessions_complete(spark, tmp_path):
    spark.createDataFrame([(1, 2, 0.1), (1, 2, 0.5), (2, 2, 0.3)], "session long, expected long, sim double").write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema("session long, expected long, sim double").parquet(str(tmp_path / "c"))
    got = activity.drain(activity.complete_sessions(stream)).collect()
    assert [(r["session"], r["chunks"], r["best"]) for r in got] == [(1, 2, 0.5)]
    lines = spark.createDataFrame([('{"type":"start","message":"Phase 2 begins"}',), ("oops",), ('{"type":"warn","message":"unknown line type x"}',)], "value string")
    assert [(r["kind"], r["phase"]) for r in activity.rescan_events(lines).collect()] == [("start", 2)]


def test_guards_and_healing(spark, tmp_path):
    from tidemark.sources import tables

    path = str(tmp_path / "list")
    assert tables.guarded(spark, path, {}) is None and tables.healed(spark, path, F.lit(True)) is None
    rows = spark.createDataFrame([("a", 2), (None, 1), ("c", 0)], "name string, completed_at int")
    rows.write.parquet(f"{path}/v=0")
    good = F.col("name").isNotNull()
    assert [r["name"] for r in tables.healed(spark, path, good).collect()] == ["c", "a"]
    assert spark.read.parquet(path).count() == 2
    assert [r["name"] for r in tables.healed(spark, path, good).collect()] == ["c", "a"]
    assert tables.guarded(spark, f"{path}/v=1", {"name": "string"}).count() == 2
    assert tables.guarded(spark, f"{path}/v=1", {"name": "int"}) is None


def test_drift_of_keys_and_senders(spark):
    from tidemark.sources import json_lines, manifests

    messages = spark.createDataFrame([("1", "human"), ("3", "tool"), ("2", "tool"), ("4", None)], "id string, sender string")
    assert [tuple(r) for r in json_lines.unknown_senders(messages).collect()] == [("tool", "2")]
    assert len(manifests.KNOWN_KEYS) == 27


def test_first_texts(spark):
    from tidemark.sources import json_lines

    lines = [
        (1, '{"type":"user","message":{"role":"assistant","content":"not the role"}}'), (2, "{broken"), (3, '{"type":"user","message":{"role":"user","content":[{"type":"tool_result"},{"type":"text","text":""},{"type":"text","text":"b"}]}}'),
        (4, '{"type":"user","message":{"role":"user","content":"later"}}'),
    ]
    df = spark.createDataFrame([("f", n, raw) for n, raw in lines] + [("g", 1, lines[3][1])], "file_id string, line_no long, raw string")
    assert {tuple(r) for r in json_lines.first_texts(df).collect()} == {("f", ""), ("g", "later")}


def test_partial_results_are_those_so_far(spark, sf, tmp_path):
    def stream():
        return activity.weekly(activity.read_events(spark, f"{sf}/events.parquet")).select("event_type", "n")

    query = activity.flush(stream(), str(tmp_path / "live"))
    query.processAllAvailable()
    query.stop()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(activity.latest(spark, str(tmp_path / "live"))) == rows(activity.drain(stream(), "complete"))


def test_files_are_opened_once_by_folds_and_found_at_their_depth_only(spark, tmp_path):
    for k in range(40):
        d = tmp_path / f"p {k}"
        (d / "deep").mkdir(parents=True)
        text = json.dumps({"type": "assistant", "message": {"model": "m", "content": [{"type": "tool_use", "name": "Bash"}, {"type": "tool_use", "name": 5}]}}) + "\n" + json.dumps({"type": "result", "duration_ms": k, "modelUsage": {"m": 1}})
        for at in (d / f"{k:02d}{ID[2:]}.jsonl", d / "deep" / f"{k:02d}{ID[2:]}.jsonl", tmp_path / f"{k:02d}{ID[2:]}.jsonl"):
            at.write_text(text)
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    lines = json_lines.transcripts(spark, str(tmp_path))
    assert spark.conf.get(key) == before and lines.count() == 80
    assert json_lines.transcript_files(spark, str(tmp_path)).count() == 40
    folds = json_lines.fold_transcripts(lines)
    logs = json_lines.fold_audit(lines.withColumnRenamed("file_id", "session_key"))
    # folds group several times; what they group is a table, not the files
    assert not [f for df in (folds, logs) for f in df.inputFiles() if f.endswith(".jsonl")]
    assert {(r["model"], tuple(r["top_tools"].items())) for r in folds.collect()} == {("m", (("Bash", 1),))}
    assert logs.agg(F.sum("duration_ms")).first()[0] == sum(range(40))


def test_hidden_folders_are_read(spark, tmp_path):
    for name in ("_a/_b/.c", "x/.y/_z", "x/y/z", "x/y"):
        (tmp_path / name).mkdir(parents=True, exist_ok=True)
        (tmp_path / name / "audit.jsonl").write_text("{}")
    found = json_lines.audits(spark, str(tmp_path))
    assert sorted(r["session_key"] for r in found.collect()) == [".c", "_z", "z"]
    assert json_lines.audit_files(spark, str(tmp_path)).count() == 3
