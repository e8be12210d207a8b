"""The few kernels that need Python: greedy text chunks, line previews of polymorphic JSON, cluster ids."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a chunk, of a block's and a line's preview, and from where a line may be expanded. The words
#: that previews put around what they cut (such as "error", "snapshot", "tracked file") are fixed values, too.
CHUNK, BLOCK_CAP, TOTAL_CAP, EXPAND = 1800, 600, 1500, 1200
_WS = re.compile(r"[\t-\r    -     　﻿]+")


def chunk(title: str | None, summary: str | None, turns: list[str] | None, fallback: str | None = None, limit: int = CHUNK) -> list[str]:
    """Head chunk of title and summary, then each turn whole or packed greedily at white space; longer words are cut."""
    out = [head[:limit]] if (head := "\n".join(x for x in (title, summary) if x)) else []
    for turn in turns or []:
        if len(turn) <= limit:
            out.append(turn)
            continue
        line: list[str] = []
        size = -1  # of the words in line, joined
        for word in _WS.split(turn):
            if len(word) > limit:
                if line:
                    out.append(" ".join(line))
                out += [word[i : i + limit] for i in range(0, len(word), limit)]
                line, size = [], -1
            elif word:
                # a full line goes out even where the word would fit an empty one only just
                if max(size, 0) + 1 + len(word) > limit:
                    out.append(" ".join(line))
                    line, size = [], -1
                line.append(word)
                size += 1 + len(word)
        if line:
            out.append(" ".join(line))
    return out or ([fallback[:limit]] if fallback else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunks(title: pd.Series, summary: pd.Series, turns: pd.Series) -> pd.Series:
    return pd.Series([chunk(a, b, None if c is None else list(c)) for a, b, c in zip(title, summary, turns, strict=True)])


@F.pandas_udf(T.StringType())
def cluster_id(members: pd.Series) -> pd.Series:
    return pd.Series([fnv_id(list(m)) for m in members])


def fnv_id(members: list[str]) -> str:
    """FNV-1a over the UTF-16 units of the sorted ids; the mark after each id leaves a signed number, and so does the last."""
    order = sorted(members, key=lambda m: m.encode("utf-16-be"))
    h = 0x811C9DC5
    for m in order:
        raw = m.encode("utf-16-le")
        for lo, hi in zip(raw[::2], raw[1::2], strict=True):
            h = (h ^ (lo | hi << 8)) * 0x01000193 & 0xFFFFFFFF
        h ^= 0x7C
    signed = h - (1 << 32) if order and h >= 1 << 31 else h
    digits = f"-{-signed:x}" if signed < 0 else f"{signed:x}"
    return "cl-" + digits.rjust(8, "0")


def _clip(s: str, cap: int) -> str:
    s = _WS.sub(" ", s).strip(" ")
    return s if len(s) <= cap else f"{s[:cap]}…(+{len(s) - cap} chars)"


def _text(x) -> str | None:
    return x if isinstance(x, str) else None


#: Input fields that describe a tool call best, in this order.
TOOL_FIELDS = ("command", "description", "prompt", "query", "pattern", "file_path", "path", "url", "notebook_path")


def _tool_call(b: dict) -> str:
    name, given = _text(b.get("name")) or ("" if b.get("name") == "" else "tool"), b.get("input")
    if not isinstance(given, dict) or not given:
        return name
    for k in TOOL_FIELDS:
        if (v := _text(given.get(k))) and v.strip():
            return f"{name} · {_clip(v, BLOCK_CAP)}"
    quoted = (f'"{v}"' if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False) for v in list(given.values())[:4])
    return f"{name} · {{{', '.join(f'{k}: {_clip(v, 60)}' for k, v in zip(given, quoted, strict=False))}}}"


def _tool_answer(b: dict) -> str:
    lead, c = "error · " if b.get("is_error") is True else "", b.get("content")
    if isinstance(c, str):
        return lead + _clip(c, BLOCK_CAP)
    if not isinstance(c, list):
        return f"{lead}(no content)"
    inner = [x for x in c if isinstance(x, dict)]
    said = [_clip(x["text"], BLOCK_CAP) if x.get("type") == "text" else f"({x.get('type') or 'block'})" for x in inner if x.get("type") != "text" or _text(x.get("text"))]
    return lead + " · ".join(said)


def _block(b) -> str:
    if isinstance(b, str):
        return _clip(b, BLOCK_CAP)
    if not isinstance(b, dict):
        return ""
    kind = _text(b.get("type"))
    if kind == "text":
        return _clip(t, BLOCK_CAP) if (t := _text(b.get("text"))) else ""
    if kind == "thinking":
        if (t := _text(b.get("thinking"))) and t.strip():
            return f"thinking · {_clip(t, BLOCK_CAP)}"
        return f"thinking · (encrypted, {len(s)} chars signature)" if (s := _text(b.get("signature"))) else "thinking · (empty)"
    known = {"redacted_thinking": lambda _: "thinking · (redacted)", "tool_use": _tool_call, "tool_result": _tool_answer}
    return known[kind](b) if kind in known else f"({kind})" if kind else ""


def _attachment(line: dict) -> str:
    a = line.get("attachment")
    if not isinstance(a, dict):
        return "attachment"
    if name := _text(a.get("file_name")):
        return f"attachment: {name}"
    if a.get("type") == "deferred_tools_delta":
        show = lambda sign, names: f"{sign}{len(names)} ({', '.join(map(str, names[:4]))}{'…' if len(names) > 4 else ''})"
        changes = [show(sign, names) for sign, key in (("+", "addedNames"), ("-", "removedNames")) if isinstance(names := a.get(key), list) and names]
        return f"deferred_tools_delta: {' '.join(changes) or '(empty)'}"
    return f"attachment ({kind})" if (kind := _text(a.get("type"))) else "attachment"


def _snapshot(line: dict) -> str:
    files = (line.get("snapshot") or {}).get("trackedFileBackups") if isinstance(line.get("snapshot"), dict) else None
    n = len(files) if isinstance(files, dict) else 0
    return f"{'snapshot update' if line.get('isSnapshotUpdate') is True else 'snapshot'} · {n} tracked file{'' if n == 1 else 's'}"


def _queued(line: dict) -> str:
    op = _text(line.get("operation"))
    return f"{op if op is not None else 'queue'} · {_clip(c, BLOCK_CAP)}" if (c := _text(line.get("content"))) else op if op is not None else "queue operation"


_LINES = {"ai-title": lambda x: _text(x.get("aiTitle")) or "", "last-prompt": lambda x: _text(x.get("lastPrompt")) or "", "attachment": _attachment, "file-history-snapshot": _snapshot, "queue-operation": _queued}


def preview_line(raw: str) -> str | None:
    """What one transcript line says, shortly; null if it is no JSON object."""
    try:
        line = json.loads(raw)
    except ValueError:
        return None
    if not isinstance(line, dict):
        return None
    if (kind := line.get("type")) in _LINES:
        return _LINES[kind](line)
    message = line.get("message")
    said = message.get("content") if isinstance(message, dict) else None
    if isinstance(said, str):
        return _clip(said, TOTAL_CAP)
    return _clip(" · ".join(filter(None, map(_block, said))), TOTAL_CAP) if isinstance(said, list) else ""


@F.pandas_udf(T.StringType())
def line_preview(raw: pd.Series) -> pd.Series:
    return raw.map(lambda s: None if s is None else preview_line(s))


def full_block(b) -> str:
    """A content block without cuts."""
    if isinstance(b, str):
        return b
    if not isinstance(b, dict):
        return ""
    for kind, key in (("text", "text"), ("thinking", "thinking")):
        if b.get("type") == kind and isinstance(b.get(key), str):
            return b[key]
    if b.get("type") == "tool_result" and isinstance(b.get("content"), str):
        return b["content"]
    if b.get("type") == "tool_use":
        return f"{b.get('name') or 'tool'}\n{json.dumps(b.get('input'), indent=2, ensure_ascii=False)}"
    return json.dumps(b, indent=2, ensure_ascii=False)


def full_line(raw: str) -> str | None:
    try:
        line = json.loads(raw)
    except ValueError:
        return None
    if not isinstance(line, dict):
        return None
    message = line.get("message")
    said = message.get("content") if isinstance(message, dict) else None
    if isinstance(said, str):
        return said
    if isinstance(said, list):
        return "\n\n---\n\n".join(filter(None, map(full_block, said)))
    return json.dumps(line, indent=2, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def line_body(raw: pd.Series) -> pd.Series:
    return raw.map(lambda s: None if s is None else full_line(s))


def should_expand(preview, full):
    return (F.coalesce(full, F.lit("")) != "") & ~full.eqNullSafe(preview) & (F.char_length(full) > EXPAND)
