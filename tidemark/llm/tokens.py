"""Token ids of the tokenizers library, each distinct stretch between white space encoded once a worker.

For a vocabulary whose normaliser and splitter drop white space (word_bpe), the ids of a text are those of
its stretches, joined. Stretches are found and looked up by hash for a whole slice of documents at once, and
held against the bytes kept for the hash; only new ones reach the library. Any other vocabulary goes through ``encode_batch`` as it is.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from . import textops
from .common import ragged_take

#: White space as Unicode has it (what the library's ``\s`` means).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class Growing:
    """A ragged array that grows by whole arrays."""

    def __init__(self, dtype):
        self.flat, self.offsets, self.n, self.rows = np.empty(1 << 16, dtype), np.zeros(1 << 16, np.int64), 0, 0

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.n + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.rows + len(lengths) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.empty_like(self.offsets)])
        self.flat[self.n : self.n + len(flat)] = flat
        self.offsets[self.rows + 1 : self.rows + 1 + len(lengths)] = self.n + np.cumsum(lengths)
        self.n, self.rows = self.n + len(flat), self.rows + len(lengths)

    def clear(self) -> None:
        self.n = self.rows = 0


class Spans:
    """The bytes of numbered stretches, to hold hits of a hash against."""

    def __init__(self):
        self.kept = Growing(np.uint8)

    def clear(self) -> None:
        self.kept.clear()

    def extend(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        flat, lengths = take_spans(data, starts, stops)
        self.kept.extend(flat, lengths)

    def unlike(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The stretches that aren't the bytes kept under their number."""
        lengths = np.diff(self.kept.offsets[: self.kept.rows + 1])[number]
        bad = lengths != stops - starts
        rest = np.flatnonzero(~bad)
        mine, n = take_spans(data, starts[rest], stops[rest])
        theirs, _ = ragged_take(self.kept.flat, self.kept.offsets, number[rest].astype(np.int64))
        if len(wrong := np.flatnonzero(mine != theirs)):
            bad[rest[np.searchsorted(np.cumsum(n), wrong, side="right")]] = True
        return np.flatnonzero(bad)


def take_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans, joined, and their lengths."""
    lengths = stops - starts
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return data[:0], lengths
    return data[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)], lengths


class Numbered(dict):
    """Gives each new key the next number and remembers it as new."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class DocumentEncoder:
    def __init__(self, path: str, limit: int = 1 << 19):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self._drops_space(spec)
        if not self.by_word:
            return
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", SPACE)
        self.pieces_of = regex.compile(f"{pattern}|\\n")
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = spec["model"]["vocab"]
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.table, self.chunks, self.spans = textops.HashTable(limit), Growing(np.int32), Spans()
        self.numbers, self.pieces = Numbered(), Growing(np.int32)

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = [(x["type"], (x.get("pattern") or {}).get("Regex")) for x in norm.get("normalizers", [])]
        first = (pre.get("pretokenizers") or [{}])[0]
        return steps == [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)] and (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True) and "[^\\s" in first["pattern"]["Regex"] and spec["model"].get("end_of_word_suffix") == "</w>"

    def _learn(self, new: list[bytes]) -> None:
        """Encode new stretches and append their ids."""
        joined = b"\n".join(new)
        odd = [i for i, w in enumerate(new) if any(s in w for s in self.special)] if any(s in joined for s in self.special) else []
        text = joined.decode("utf-8", "replace")
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        found = self.pieces_of.findall(text)
        self.numbers.new.clear()
        at = np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
        if pending := self.numbers.new:
            ids = np.concatenate([np.array(e.ids, np.int32) for e in self.model.encode_batch_fast([" ".join(pending[i : i + 512]) for i in range(0, len(pending), 512)], add_special_tokens=False)])
            lengths = np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0)
            if "\n" in self.numbers and self.numbers["\n"] >= self.pieces.rows:  # the mark between stretches has no ids
                lengths = np.insert(lengths, self.numbers["\n"] - self.pieces.rows, 0)
            assert len(lengths) == len(pending) and lengths.sum() == len(ids)
            self.pieces.extend(ids, lengths)
        flat, lengths = ragged_take(self.pieces.flat, self.pieces.offsets, at)
        mark = at == self.numbers.get("\n", -1)
        sums = np.bincount(np.cumsum(mark), weights=lengths, minlength=len(new)).astype(np.int64)
        if odd:
            rows = np.split(flat, np.cumsum(sums)[:-1])
            for i, e in zip(odd, self.whole.encode_batch([new[i].decode() for i in odd], add_special_tokens=False), strict=True):
                rows[i] = np.array(e.ids, np.int32)
            flat, sums = np.concatenate(rows), np.array([len(r) for r in rows])
        self.chunks.extend(flat, sums)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, joined, and each document's number of ids."""
        if not self.by_word:
            raw = data.tobytes()
            done = self.whole.encode_batch([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], add_special_tokens=False)
            counts = np.array([len(e.ids) for e in done], np.int64)
            return np.concatenate([np.array(e.ids, np.int32) for e in done] or [np.empty(0, np.int32)]), counts
        starts, stops, first = textops.words(data, offsets)
        h = textops.hash_spans(data, starts, stops)
        number = self.table.find(h)
        if len(missing := np.flatnonzero(number < 0)):
            fresh, where = np.unique(h[missing], return_index=True)
            if self.table.count + len(fresh) > self.table.limit:
                self.table.clear(), self.chunks.clear(), self.spans.clear(), self.pieces.clear(), self.numbers.clear()
                missing = np.arange(len(h))
                fresh, where = np.unique(h, return_index=True)
                if len(fresh) > self.table.limit:
                    self.table = textops.HashTable(1 << int(len(fresh)).bit_length())
            where = missing[where]
            raw = data.tobytes()
            self._learn([raw[a:b] for a, b in zip(starts[where].tolist(), stops[where].tolist(), strict=True)])
            self.spans.extend(data, starts[where], stops[where])
            self.table.add(fresh)
            number[missing] = self.table.find(h[missing])
        if len(bad := self.spans.unlike(data, starts, stops, number)):  # another stretch has the same hash
            self._learn([data[a:b].tobytes() for a, b in zip(starts[bad].tolist(), stops[bad].tolist(), strict=True)])
            self.spans.extend(data, starts[bad], stops[bad])
            number[bad] = self.table.skip(len(bad))
        flat, lengths = ragged_take(self.chunks.flat, self.chunks.offsets, number.astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return flat, np.diff(ends[first])


_encoders: dict[str, DocumentEncoder] = {}


def encoder(path: str) -> DocumentEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = DocumentEncoder(path)
    return _encoders[path]
