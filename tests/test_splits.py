"""Files of any size by many tasks: numbered lines, arrays; ranks over the whole list."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import search
from tidemark.sources import archives, fixtures, json_arrays, json_lines


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)


def plain_lines(text):
    parts = [x.removesuffix("\r") for x in text.split("\n")]
    return [(k, x) for k, x in enumerate(parts, 1) if x]


def test_lines_keep_their_numbers_over_splits(small_splits, tmp_path):
    rng = random.Random(5)
    texts = {}
    for name in "abc":
        lines = ["x" * rng.choice((0, 1, 40, 3000)) + rng.choice(("", "\r", "é日")) for _ in range(400)]
        texts[name] = "\n".join(lines)
    texts |= {"empty": "", "blank": "\n\r\n\n", "one": "no end", "long": "y" * 50_000 + "\n\nz", "ends": "a\r\n\r\nb\r\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.jsonl").write_bytes(text.encode())
    df = json_lines.read_lines(small_splits, f"{tmp_path}/*.jsonl")
    assert df.rdd.getNumPartitions() > 20
    got = {}
    for r in df.collect():
        got.setdefault(r["path"].rsplit("/", 1)[1].removesuffix(".jsonl"), []).append((r["line_no"], r["raw"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, t in texts.items() if (w := plain_lines(t))}


def test_lines_of_a_file_that_grows_between_the_passes_fail(small_splits, tmp_path):
    log = tmp_path / "a.jsonl"
    log.write_text("line\n" * 5000)
    df = json_lines.read_lines(small_splits, str(log))
    log.write_text("line\n" * 9000)
    with pytest.raises(Exception, match="other splits|FILE|file"):
        df.collect()


def odd(rng):
    """Texts that look like structure."""
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "\n", " ", "},{", "]]", 'a"b', "\\\\", "日本"]) for _ in range(rng.randint(0, 30)))


@pytest.mark.parametrize("indent,separators", [(None, (",", ":")), (2, None), (None, (" , ", " : "))])
def test_arrays_equal_those_of_one_reader(small_splits, tmp_path, monkeypatch, indent, separators):
    monkeypatch.setattr(json_arrays, "CHUNK", 500)
    rng = random.Random(11)
    data = [{"uuid": str(k), "name": odd(rng), "summary": odd(rng) * rng.choice((1, 1, 1, 90)), "chat_messages": [{"sender": "human", "text": odd(rng), "content": [{"type": odd(rng)}]} for _ in range(rng.randint(0, 4))]} for k in range(300)]
    path = tmp_path / "conversations.json"
    path.write_text("\n " + json.dumps(data, indent=indent, separators=separators, ensure_ascii=False) + " \n\n")
    found = json_arrays.elements(small_splits, str(path))
    rows = found.collect()
    assert [json.loads(r["raw"]) for r in sorted(rows, key=lambda r: tuple(r["at"]))] == data
    assert len({r["at"]["split_start"] for r in rows}) > 5
    talks = archives.read_conversations(small_splits, str(path)).collect()
    assert sorted((t["uuid"], t["name"], len(t["chat_messages"])) for t in talks) == sorted((d["uuid"], d["name"], len(d["chat_messages"])) for d in data)


def test_arrays_that_are_short_mixed_or_broken(spark, tmp_path):
    def read(text):
        path = tmp_path / f"{abs(hash(text))}.json"
        path.write_text(text)
        return [r["raw"].strip() for r in sorted(json_arrays.elements(spark, str(path)).collect(), key=lambda r: tuple(r["at"]))]

    assert read("[]") == read(" [ \n ] ") == []
    assert read('[1, "a,]}", [2, {"b": 3}], null ,{}]') == ["1", '"a,]}"', '[2, {"b": 3}]', "null", "{}"]
    assert read(r'["\\", "\"", "\\\"]"]') == [r'"\\"', r'"\""', r'"\\\"]"']
    for bad in ("", "{}", '{"a": [1]}', '[{"a": 1}', '["a]', "[[1]", "text"):
        with pytest.raises(ValueError, match="no array"):
            read(bad)


def test_optional_members(spark, tmp_path):
    (tmp_path / "users.json").write_text('[{"uuid": "u", "full_name": "A B", "email_address": "a@b"}, {"full_name": "none"}, 3]')
    (tmp_path / "memories.json").write_text('[{"conversations_memory": "m", "account_uuid": "u"}]')
    (tmp_path / "projects.json").write_text('[{"uuid": "p", "name": "Pro')
    assert [tuple(r) for r in archives.read_optional(spark, f"{tmp_path}/users.json", archives.USERS).collect()] == [("u", "A B", "a@b")]
    assert [tuple(r) for r in archives.read_optional(spark, f"{tmp_path}/memories.json", archives.MEMORIES).collect()] == [("m", "u")]
    assert archives.read_projects(spark, f"{tmp_path}/projects.json").count() == 0
    assert archives.read_optional(spark, f"{tmp_path}/none.json", archives.USERS).count() == 0
    assert archives.mask_label("data-0123456789ab-cdef-2024.zip") == "data-0123….zip"


def test_written_arrays_are_read_again(spark, tmp_path):
    rows = spark.range(50).repartition(3).select(F.to_json(F.struct(F.col("id").cast("string").alias("uuid"), F.lit("a,b] }").alias("name"))).alias("raw"))
    for df, n in ((rows, 50), (rows.limit(0), 0)):
        folder = f"file://{tmp_path}/out-{n}"
        fixtures.write_arrays(df, folder)
        assert sorted(int(r["uuid"]) for r in archives.read_conversations(spark, f"{folder}/part-*").collect()) == list(range(n))


@pytest.mark.parametrize("axis", ["recent", "oldest", "turns", "project"])
def test_ranks_and_neighbours_of_the_whole_list(spark, axis):
    rng = random.Random(3)
    data = [(f"s{k}", rng.choice((1, 1, 1, 5, 9)), rng.choice((3, 3, 4)), rng.choice((None, "b", "a", "")), k) for k in range(500)]
    df = spark.createDataFrame(data, "id string, updated_at long, user_turns long, project string, pos long").repartition(7)
    key = {"recent": lambda r: (-r[1],), "oldest": lambda r: (r[1],), "turns": lambda r: (-r[2], -r[1]), "project": lambda r: (r[3] if r[3] is not None else "\x01", -r[1])}[axis]
    ids = [r[0] for r in sorted(data, key=lambda r: (*key(r), r[4]))]
    want = {i: (k + 1, ids[k - 1] if k else None, ids[k + 1] if k < 499 else None) for k, i in enumerate(ids)}
    got = search.neighbours(df, axis)
    assert {r["id"]: tuple(r)[1:] for r in got.collect()} == want
    assert [r["id"] for r in search.nth_page(df, axis, 3).orderBy("rank").collect()] == ids[100:150]
    assert search.neighbours(df.limit(0), axis).count() == 0 and search.neighbours(df.where("pos = 7"), axis).collect()[0][1:] == (1, None, None)


def test_structure_takes_few_bytes_a_byte_and_equals_a_plain_reader():
    rng = random.Random(3)
    for inside in (False, True):
        text = "".join(odd(rng) for _ in range(200)).encode()
        data, outside, change = json_arrays._structure(text, inside)
        assert outside.nbytes + change.nbytes <= 2 * len(text)
        quoted, escaped, expected = inside, False, []
        for b in text:
            mark = b == ord('"') and not escaped
            quoted ^= mark
            escaped = b == ord("\\") and not escaped
            expected.append((not quoted, 0 if quoted else (b in b"[{") - (b in b"]}")))
        assert list(zip(outside.tolist(), change.tolist())) == expected
