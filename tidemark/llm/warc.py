"""WARC: archives written and read, and captures assembled from their records (operator 3).

Each capture is a request, a response (or a revisit of an equal payload) and a metadata record; request and
metadata name the response in WARC-Concurrent-To. A response holds the HTTP status and headers before its payload. Files are ordinary ``.warc.gz`` archives, one gzip member a
record, in the folder that all executors share.

Results defined for odd input: a null html is an empty payload; a null url leaves WARC-Target-URI out and comes
back null; null page_ids stay null and never are what others refer to; rows repeated with page_id and payload
equal are all of the same record type and come back as often as they went in; an empty table writes no file and
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, fresh_path, materialize, read_table

#: Payloads below this many bytes are stored each time.
LEAST_REVISIT = 100
#: A file is closed once it holds this many bytes, so that one task reads it in bounded memory and time.
FILE_BYTES = 8 << 20
#: Archive bytes that a task reads, where there are enough.
TASK_BYTES = 256 << 20
#: Compressed bytes given to the decompressor at once.
STEP = 1 << 14
FILES = "path string, n_records long, n_bytes long"
RECORDS = "record_id string, record_type string, target_uri string, concurrent_to array<string>, refers_to string, date string, payload_digest string, payload_bytes long, fields string, page_id long, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures of a table without crawl times share this one (a fixed value; nothing reads the clock).
DATE = "2024-01-01T00:00:00Z"


def record(kind: str, record_id: str, block: bytes, headers: list[tuple[str, str | None]]) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n"
    return squeeze.compress(head) + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def records(raw: bytes):
    """(headers, block) of each record of an archive, whether its gzip members hold one record or many, or it isn't compressed."""
    if raw[:2] == b"\x1f\x8b":
        at, text = 0, b""
        while at < len(raw):
            member, parts = zlib.decompressobj(31), [text]
            while not member.eof and at < len(raw):
                parts.append(member.decompress(raw[at : at + STEP]))
                at = min(at + STEP, len(raw))
            if not member.eof:
                raise ValueError("the archive ends within a gzip member")
            at -= len(member.unused_data)
            *whole, text = _plain(b"".join(parts))
            yield from whole
        if text.strip():
            raise ValueError("the archive ends within a record")
    else:
        found = list(_plain(raw))
        if found[-1].strip():
            raise ValueError("the archive ends within a record")
        yield from found[:-1]


def _plain(raw: bytes):
    """The whole records of ``raw``, then what is left of it."""
    at = 0
    while True:
        while raw[at : at + 2] == b"\r\n":
            at += 2
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            break
        version, *lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers: list[tuple[str, str]] = []
        for line in lines:
            if line[:1] in " \t" and headers:
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
            else:
                k, _, v = line.partition(":")
                headers.append((k.strip().lower(), v.strip()))
        size = int(dict(headers)["content-length"])
        if len(raw) < end + 4 + size:
            break
        yield headers, raw[end + 4 : end + 4 + size]
        at = end + 4 + size
    yield raw[at:]


def _name(kind: str, *parts) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, "|".join([kind, *map(str, parts)])).urn


def _one_line(url: str | None) -> str | None:
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def capture_records(page_id, url, payload: bytes, digest: str, first_id) -> list[bytes]:
    """The three records of one page; ``first_id`` is the page that it revisits, or None."""
    uri, sha = _one_line(url), "sha256:" + base64.b32encode(bytes.fromhex(digest)).decode()
    main, common = _name("main", page_id, digest), [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    digests = [("WARC-Payload-Digest", sha)]
    if first_id is None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        content = record("response", main, http + payload, [*common, *digests, ("Content-Type", "application/http; msgtype=response")])
    else:
        content = record("revisit", main, b"", [*common, *digests, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_name('main', first_id, digest)}>")])
    path = (uri or "/").partition("://")[2].partition("/")
    asked = f"GET /{path[2]} HTTP/1.1\r\nHost: {path[0]}\r\n\r\n".encode()
    near = [*common, ("WARC-Concurrent-To", f"<{main}>")]
    fields = f"payload-bytes: {len(payload)}\r\n" + ("" if page_id is None else f"page-id: {page_id}\r\n") + ("" if url is None else f"url: {base64.b64encode(url.encode()).decode()}\r\n")
    return [
        record("request", _name("request", page_id, digest), asked, [*near, ("Content-Type", "application/http; msgtype=request")]),
        content,
        record("metadata", _name("metadata", page_id, digest), fields.encode(), [*near, ("Content-Type", "application/warc-fields")]),
    ]


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and first_id: the smallest page_id of an equal payload, where this row is a revisit of it.

    Only digests are grouped (pre-aggregated, so copies by the million are one row a task); the join has one row
    a repeated payload on one side, and adaptive execution splits a hot payload on the other.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = F.octet_length("html") >= LEAST_REVISIT
    firsts = materialize(rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL").drop("n"), "warc-firsts")
    found = rows.join(firsts, "digest", "left")
    return found.withColumn("first_id", F.when(F.col("page_id").eqNullSafe(F.col("first_id")), None).otherwise(F.col("first_id")))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``pages`` (page_id, url, html); one row a file. A file appears by a rename, complete."""

    def write(batches):
        task = TaskContext.get()
        store, base = pafs.FileSystem.from_uri(folder)
        held: list[bytes] = []
        size = number = 0

        def close():
            nonlocal held, size, number
            name = f"{base}/{task.partitionId():06d}-{number:05d}.warc.gz"
            with store.open_output_stream(part := f"{name}.{task.taskAttemptId()}.open") as f:
                f.write(b"".join(held))
            store.move(part, name)
            row = {"path": name, "n_records": len(held), "n_bytes": size}
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_pylist([row], schema=arrow_type(FILES))

        for batch in batches:
            rest = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "first_id")]
            for html, page_id, url, digest, first in zip(batch.column("html"), *rest, strict=True):
                new = capture_records(page_id, url, html.as_py().encode(), digest, first)
                if not held and not number:
                    store.create_dir(base, recursive=True)
                held += new
                size += sum(map(len, new))
                if size >= FILE_BYTES:
                    yield close()
        if held:
            yield close()

    return materialize(mark_revisits(pages).select("page_id", "url", "html", "digest", "first_id").mapInArrow(write, FILES), "warc-files")


def read_records(files: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """One row a record. Digests and sizes are of the block that was read, and held against what its headers claim."""

    def read(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(row["path"], compression=None) as f:
                    raw = f.read()
                out, n, held = [], 0, 0
                for headers, block in records(raw):
                    h = dict(headers)
                    kind, is_page = h["warc-type"], h["warc-type"] == "response"
                    if is_page and h.get("content-type", "").startswith("application/http"):  # the payload is what follows status and headers
                        block = block.partition(b"\r\n\r\n")[2]
                    fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x) if kind == "metadata" else {}
                    claimed = h.get("warc-payload-digest")
                    digest = hashlib.sha256(block).hexdigest() if is_page else base64.b32decode(claimed.partition(":")[2]).hex() if claimed else None
                    if is_page and claimed and base64.b32decode(claimed.partition(":")[2]).hex() != digest:
                        raise ValueError(f"{row['path']}: the payload of {h['warc-record-id']} isn't what its digest says")
                    out.append({
                        "record_id": h["warc-record-id"].strip("<>"), "record_type": kind, "target_uri": base64.b64decode(fields["url"]).decode() if "url" in fields else None if kind == "metadata" else h.get("warc-target-uri"),
                        "concurrent_to": [v.strip("<>") for k, v in headers if k == "warc-concurrent-to"], "refers_to": h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None,
                        "date": h.get("warc-date"), "payload_digest": digest, "payload_bytes": len(block) if is_page else int(fields["payload-bytes"]) if "payload-bytes" in fields else None,
                        "fields": block.decode() if kind == "metadata" else None, "page_id": int(fields["page-id"]) if "page-id" in fields else None, "payload": block if with_payload and is_page else None,
                    })
                    n, held = n + 1, held + (len(block) if with_payload else 0)
                    if len(out) >= 4096 or held > FILE_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow_type(RECORDS))
                        out, held = [], 0
                if n != row["n_records"]:
                    raise ValueError(f"{row['path']} holds {n} records, not {row['n_records']}")
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow_type(RECORDS))

    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()
    tasks = min(total["n"], max(4 * files.sparkSession.sparkContext.defaultParallelism, total["b"] // TASK_BYTES))
    return files.repartition(max(1, tasks), "path").mapInArrow(read, RECORDS)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row a capture: its main record (response or revisit), request and metadata.

    A request or metadata record belongs to the main record that it names in WARC-Concurrent-To; a main record
    may name them instead. All records of a capture are grouped by the main record's id in one shuffle. A group
    is one capture (three records), so its size doesn't follow the data; copies of one capture come out as often
    as it has main records.
    """
    is_main = F.col("record_type").isin("response", "revisit")
    own = F.struct("record_id", "record_type", "target_uri", "refers_to", "date", "payload_digest", "payload_bytes", "payload")
    side = F.struct("record_id", "target_uri", "fields", "page_id", "payload_bytes")
    named = found.withColumn("to", F.explode(F.when(is_main, F.array("record_id")).otherwise(F.col("concurrent_to"))))
    listed = found.where(is_main & (F.size("concurrent_to") > 0)).select(F.col("record_id").alias("to"), F.explode("concurrent_to").alias("record_id"))
    back = found.where(~is_main).join(listed, "record_id").select(*named.columns)
    kind = F.col("record_type")
    captures = named.unionByName(back).groupBy("to").agg(
        F.first(F.when(is_main, own), ignorenulls=True).alias("main"), F.sum(is_main.cast("int")).alias("copies"),
        F.first(F.when(kind == "request", side), ignorenulls=True).alias("request"), F.first(F.when(kind == "metadata", side), ignorenulls=True).alias("metadata"),
    )
    return captures.where("main IS NOT NULL").withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).drop("to", "copy", "copies")


def op3_warc_transactions(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc", lasting=True)
    files = write_archives(read_table(spark, sf_dir, "pages"), folder)
    captures = materialize(assemble(read_records(files, folder, with_payload=False)), "captures")
    flat = captures.select(
        F.col("metadata.page_id").alias("page_id"), F.coalesce("main.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"), F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.record_type").alias("record_type"), F.col("main.refers_to").alias("refers_id"), F.col("metadata.target_uri").alias("url"),
    )
    targets = captures.where("main.record_type = 'response'").groupBy(F.col("main.record_id").alias("refers_id")).agg(F.min("metadata.page_id").alias("refers_to"))
    return flat.join(materialize(targets, "targets"), "refers_id", "left").drop("refers_id")


ORACLE = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, url, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
       url
FROM f
"""
