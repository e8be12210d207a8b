"""The whole build over raw files, the command line, and the demo corpus."""

import itertools
import json
import zipfile

import pytest

from tidemark import __main__ as cli
from tidemark.operators import duplicates, lifecycle, sessions
from tidemark.plans import build
from tidemark.sources import fixtures

ID = "01234567-89ab-cdef-0123-456789abcdef"
NOW = 1_760_000_000_000


@pytest.fixture
def raw(tmp_path):
    t = tmp_path / "transcripts" / "p"
    t.mkdir(parents=True)
    (t / f"{ID}.jsonl").write_text(json.dumps({"type": "user", "cwd": "/w/app", "timestamp": "2025-01-01T00:00:00Z", "message": {"content": "hello"}}))
    d = tmp_path / "desktop" / ID / ID
    d.mkdir(parents=True)
    (d / f"local_{ID}.json").write_text(json.dumps({"sessionId": "local_s", "cliSessionId": ID, "createdAt": 1, "lastActivityAt": 2, "title": "Named", "cwd": "/w/app", "model": "m"}))
    text = "a question that is certainly longer than forty characters, for duplicates"
    talk = lambda u: {"uuid": u, "name": u, "created_at": "2025-01-01T00:00:00Z", "updated_at": "2025-01-02T00:00:00Z", "chat_messages": [{"sender": "human", "text": text}]}
    with zipfile.ZipFile(tmp_path / "export.zip", "w") as z:
        z.writestr("conversations.json", json.dumps([talk("c1"), talk("c2")]))
        z.writestr("projects.json", "[]")
    return tmp_path


def test_command_line_builds_and_keeps_cloud_sessions(spark, raw, monkeypatch):
    monkeypatch.setattr(cli, "build", lambda: spark)
    out = str(raw / "out")
    common = ["--out", out, "--now", str(NOW), "--transcripts", str(raw / "transcripts"), "--desktop", str(raw / "desktop")]
    assert cli.main(["all", *common, "--zip", str(raw / "export.zip")]) == 0
    got = {(r["source"], r["id"]): r for r in spark.read.parquet(f"{out}/sessions").collect()}
    assert set(got) == {("cloud", "c1"), ("cloud", "c2"), ("cli-desktop", ID)} or set(got) == {("cloud", "c1"), ("cloud", "c2"), ("cli-desktop", "local_s"), ("cli-desktop", ID)}
    meta = spark.read.parquet(f"{out}/analysis/meta").first()
    assert (meta["clusters"], meta["duplicate_sessions"]) == (1, 2)
    assert cli.main(["all", *common, "--no-cloud"]) == 0
    assert spark.read.parquet(f"{out}/sessions").where("source = 'cloud'").count() == 2
    assert cli.main(["analyze", "--out", out, "--now", str(NOW)]) == 0
    with pytest.raises(SystemExit):
        cli.main(["all", "--out", out, "--no-cloud", "--zip", "x"])


def test_duplicates_read_the_whole_first_text_and_rescans_reuse(spark, tmp_path):
    """Texts that differ after 200 characters are no duplicates; a transcript whose time is unchanged isn't folded again; one that changed is."""
    import os

    from tidemark.sources import json_lines

    other = "11234567-89ab-cdef-0123-456789abcdef"
    folder = tmp_path / "t" / "p"
    folder.mkdir(parents=True)
    same = "the same beginning " * 20
    line = lambda s: json.dumps({"type": "user", "cwd": "/w/app", "timestamp": "2025-01-01T00:00:00Z", "message": {"role": "user", "content": s}})
    for name, end in ((ID, "one"), (other, "two")):
        (folder / f"{name}.jsonl").write_text(line(same[:350] + end))
    out = str(tmp_path / "out")
    src = build.Sources(transcripts=str(tmp_path / "t"))
    assert build.build(spark, src, out, NOW).count() == 0
    assert spark.read.parquet(f"{out}/analysis/duplicates.exact").count() == 0
    times = {r["raw_session_id"]: r["source_mtime_ms"] for r in spark.read.parquet(f"{out}/sessions").collect()}
    assert set(times) == {ID, other}
    (folder / f"{other}.jsonl").write_text(line(same[:350] + "one"))
    os.utime(folder / f"{other}.jsonl", (2_000_000_000, 2_000_000_000))
    now = json_lines.transcript_files(spark, src.transcripts).selectExpr("'cli-direct' AS source", "file_id AS raw_session_id", "mtime_ms AS source_mtime_ms")
    good, again = build.split_changed(now, spark.read.parquet(f"{out}/sessions"))
    assert [r["raw_session_id"] for r in good.collect()] == [ID] and {r["raw_session_id"] for r in again.collect()} == {other}
    assert build.build(spark, src, out, NOW).count() == 0
    assert [r["size"] for r in spark.read.parquet(f"{out}/analysis/duplicates.exact").collect()] == [2]
    record = spark.read.parquet(f"{out}/analysis/zombies.heuristic").first()
    assert (record["display_name"], record["inference_source"], record["probe_ids"], record["burst_windows"]) == ("app", "project_field", [], [])


def test_nothing_to_build(spark, tmp_path):
    with pytest.raises(ValueError, match="no source"):
        build.build(spark, build.Sources(), str(tmp_path), NOW)


def test_demo_corpus(spark):
    assert [round(x, 6) for x in itertools.islice(fixtures.mulberry32(1), 2)] == [round(x, 6) for x in itertools.islice(fixtures.mulberry32(1), 2)]
    df = sessions.from_conversations(fixtures.demo_conversations(spark)).withColumnRenamed("human_texts", "t")
    clusters = duplicates.exact_clusters(df.selectExpr("id", "t[0] AS first_human_text", "xxhash64(id) AS pos"))
    assert sorted(r["size"] for r in clusters.collect()) == [3, 4]
    life = lifecycle.classify(df.selectExpr("regexp_extract(title, '^(Orchard [0-9])', 1) AS project", "started_at", "updated_at", "title", "preview", "xxhash64(id) AS pos").where("project <> ''"), NOW)
    kinds = {r["project"]: r["classification"] for r in life.collect()}
    assert len(kinds) == 6
    assert kinds["Orchard 0"] == "zombie"


def test_embedding_seam(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id int, text string")
    got = {r["key"]: r["vec"] for r in fixtures.embed(df).collect()}
    assert got["1"] == got["2"]
    assert sum(x * x for x in got["1"]) == pytest.approx(1, abs=1e-6)


def manifest_file(root, key, **more):
    d = root / ID / ID
    d.mkdir(parents=True, exist_ok=True)
    path = d / f"local_{key}.json"
    path.write_text(json.dumps({"sessionId": f"local_{key}", "createdAt": 1, "lastActivityAt": 2, "title": "T", "cwd": "/w", "model": "m"} | more))
    return path


def stored(spark, out):
    return {(r["source"], r["id"]): r for r in spark.read.parquet(f"{out}/sessions").collect()}


def counts(spark, out):
    return spark.read.parquet(f"{out}/manifest").first()["counts"]


def report(spark, out):
    return {(r["kind"], r["name"]): r["n"] for r in spark.read.parquet(f"{out}/report").collect()}


def test_cowork_sessions_are_taken_again_and_changed_ones_read(spark, tmp_path):
    import os

    keys = [f"{k}1234567-89ab-cdef-0123-456789abcdef" for k in "ab"]
    root, out = tmp_path / "c", str(tmp_path / "out")
    for k in keys:
        os.utime(manifest_file(root, k, cliSessionId=k, **({"strange": 1} if k == keys[0] else {})), (1_700_000_000, 1_700_000_000))
        log = root / ID / ID / f"local_{k}"
        log.mkdir()
        (log / "audit.jsonl").write_text(json.dumps({"type": "user", "message": {"role": "user", "content": "hi " + k}}) + "\n" + json.dumps({"type": "result", "total_cost_usd": 1.5}) + "\n{broken\n")
    (root / ID / ID / f"local_c{ID[1:]}.json").write_text("{")
    src = build.Sources(cowork=str(root))
    assert build.build(spark, src, out, NOW).count() == 0
    assert {i: r["total_cost_usd"] for (_, i), r in stored(spark, out).items()} == {k: 1.5 for k in keys}
    assert report(spark, out) == {("read", "cowork"): 2, ("malformed lines", "cowork"): 2, ("unknown manifest member", "strange"): 1, ("refused manifest", "cowork"): 1}
    # logs change, but only one manifest does: the other session stays as it was
    for k in keys:
        (root / ID / ID / f"local_{k}" / "audit.jsonl").write_text(json.dumps({"type": "result", "total_cost_usd": 9.0}))
    manifest_file(root, keys[1], cliSessionId=keys[1], title="New")
    assert build.build(spark, src, out, NOW).count() == 0
    got = stored(spark, out)
    assert [(got["cowork", k]["title"], got["cowork", k]["total_cost_usd"]) for k in keys] == [("T", 1.5), ("New", 9.0)]
    assert {k: v for k, v in report(spark, out).items() if k[0] in ("read", "reused")} == {("read", "cowork"): 1, ("reused", "cowork"): 1}
    texts = {r["raw_session_id"]: r["first_human_text"] for r in spark.read.parquet(f"{out}/first_texts").collect()}
    assert texts == {k: "hi " + k for k in keys}


def test_sources_that_vanish_leave_nothing(spark, tmp_path):
    """What was scanned is replaced, also by nothing; other sources stay; the manifest says what is stored."""
    root, logs, out = tmp_path / "c", tmp_path / "t", str(tmp_path / "out")
    path = manifest_file(root, ID)
    (logs / "p").mkdir(parents=True)
    (logs / "p" / f"{ID}.jsonl").write_text(json.dumps({"type": "user", "timestamp": "2025-01-01T00:00:00Z", "message": {"content": "x"}}))
    build.build(spark, build.Sources(cowork=str(root), transcripts=str(logs)), out, NOW)
    assert counts(spark, out) == {"cloud": 0, "cowork": 1, "cli-direct": 1, "cli-desktop": 0}
    path.unlink()
    build.build(spark, build.Sources(cowork=str(root)), out, NOW)
    assert set(stored(spark, out)) == {("cli-direct", ID)} and counts(spark, out) == {"cloud": 0, "cowork": 0, "cli-direct": 1, "cli-desktop": 0}
    (logs / "p" / f"{ID}.jsonl").unlink()
    build.build(spark, build.Sources(transcripts=str(logs)), out, NOW)
    assert counts(spark, out) == {"cloud": 0, "cowork": 0, "cli-direct": 0, "cli-desktop": 0}


def test_stored_desktop_sessions_stand_for_manifests(spark, tmp_path, monkeypatch, capsys):
    """The second phase without manifests: enriched from the stored sessions of the first, reused while unchanged; those without a transcript stay."""
    other = "b" + ID[1:]
    desk, logs, out = tmp_path / "d", tmp_path / "t", str(tmp_path / "out")
    for k in (ID, other):
        manifest_file(desk, k, cliSessionId=k, title="Named " + k[0])
    (logs / "p").mkdir(parents=True)
    (logs / "p" / f"{ID}.jsonl").write_text("\n".join(json.dumps({"type": "user", "timestamp": "2025-01-01T00:00:00Z", "message": {"content": "x"}}) for _ in range(3)))
    monkeypatch.setattr(cli, "build", lambda: spark)
    assert cli.main(["cowork", "--out", out, "--now", str(NOW), "--desktop", str(desk)]) == 0
    assert {r["user_turns"] for r in stored(spark, out).values()} == {0}
    for kind in ("read", "reused"):
        capsys.readouterr()
        assert cli.main(["cli", "--out", out, "--now", str(NOW), "--transcripts", str(logs), "--progress"]) == 0
        assert [json.loads(x)["phase"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")] == ["scan", "merge", "write", "analyse"]
        got = stored(spark, out)
        assert {k: (r["title"], r["user_turns"]) for k, r in got.items()} == {("cli-desktop", ID): ("Named 0", 3), ("cli-desktop", other): ("Named b", 0)}
        assert report(spark, out)[kind, "cli-desktop"] == 1
    # manifests alone again: what transcripts told stays
    assert cli.main(["cowork", "--out", out, "--now", str(NOW), "--desktop", str(desk)]) == 0
    assert stored(spark, out)["cli-desktop", ID]["user_turns"] == 3
    elsewhere = str(tmp_path / "else")
    assert cli.main(["cli", "--out", elsewhere, "--now", str(NOW), "--transcripts", str(logs)]) == 0
    assert set(stored(spark, elsewhere)) == {("cli-direct", ID)}
    assert cli.main(["cli", "--out", elsewhere, "--now", str(NOW), "--transcripts", str(logs), "--phase2-output", f"{out}/sessions"]) == 0
    assert ("cli-desktop", ID) in stored(spark, elsewhere)
    assert cli.main(["empty", "--out", str(tmp_path / "none"), "--now", "1"]) == 0
    assert counts(spark, str(tmp_path / "none")) == {"cloud": 0, "cowork": 0, "cli-direct": 0, "cli-desktop": 0}


def test_projects_senders_and_labels_of_an_upload(spark, tmp_path):
    """Names match title before summary in list order; an upload discards labels of the corpus before it."""
    from tidemark.sources import tables

    talk = lambda u, name, summary="": {"uuid": u, "name": name, "summary": summary, "created_at": "2025-01-01T00:00:00Z", "updated_at": f"2025-01-0{len(u) + 1}T00:00:00Z", "chat_messages": [{"sender": "robot", "text": "x"}, {"sender": "human", "text": "y"}]}
    path, out = tmp_path / "conversations.json", str(tmp_path / "out")
    path.write_text(json.dumps([talk("a", "on Garden plan"), talk("b", "nothing", "the Orchard and the garden plan"), talk("c", "", "garden plan"), {"uuid": "d", "created_at": "?"}]))
    (tmp_path / "projects.json").write_text(json.dumps([{"uuid": "1", "name": "Orchard"}, {"uuid": "2", "name": " garden plan "}, {"uuid": "3", "name": "nothing to see"}]))
    src = build.Sources(conversations=str(path), projects=str(tmp_path / "projects.json"))
    build.build(spark, src, out, NOW)
    assert {i: r["project"] for (_, i), r in stored(spark, out).items()} == {"a": "garden plan", "b": "Orchard", "c": None}
    assert report(spark, out) == {("skipped conversations", "cloud"): 1, ("unknown sender", "robot"): 1}
    labels = spark.createDataFrame([("c", "Shelf")], "id string, label string")
    tables.store_labels(labels, tables.all_sessions(spark, f"{out}/sessions"), f"{out}/labels")
    build.build(spark, src, out, NOW)
    assert "Shelf" in {r["project"] for r in spark.read.parquet(f"{out}/analysis/zombies.heuristic").collect()}
    path.write_text(json.dumps([talk("a", "on Garden plan"), talk("cc", "new")]))
    build.build(spark, src, out, NOW)
    assert "Shelf" not in {r["project"] for r in spark.read.parquet(f"{out}/analysis/zombies.heuristic").collect()} and tables.previous(spark, f"{out}/labels") is None


def test_bodies_are_stored_apart_from_slim_records(spark, tmp_path):
    from tidemark.sources import tables

    talks = fixtures.demo_conversations(spark)
    records = sessions.from_conversations(talks)
    tables.write_conversations(talks, records, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/messages").count() == talks.count()
    slim = spark.read.parquet(f"{tmp_path}/sessions")
    assert "human_texts" not in slim.columns and slim.count() == records.count()
