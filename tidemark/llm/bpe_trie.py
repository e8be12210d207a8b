"""BPE encoding and decoding by a prefix-sharing trie traversal (operator 6).

New words of a slice are put in byte order, which is the depth-first order of their trie; the traversal keeps,
for each byte of the current path, the last token of the encoding of that prefix, so a prefix that words share
is encoded once. The last token of a longer prefix is the one token that is a suffix of it and may follow the
last token of what stands before it; whether one token may follow another is read off the merges on the two
spines where they touch. Encodings of words are kept a worker, so text costs one table look-up a word.

Results defined for odd input: null text encodes to no ids (empty text); ids that are null or outside the
vocabulary decode to nothing; bytes that are no UTF-8 decode to U+FFFD as the library does; null and repeated
doc_ids stay as they are, one row a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import arrow_type, ragged_take, read_table, text_bytes, text_slices
from .tokens import SPACE, Growing, Numbered, Spans

#: The published splitting pattern of this byte-level family, with white space spelled out (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, and which token may follow which."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {t.encode(): i for t, i in special.items()}
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if t not in special}
        self.size = max([*self.bytes, *special.values()]) + 1
        ids = model["vocab"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.parts: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        for (a, b), r in zip(self.rank, range(len(pairs)), strict=True):
            whole = ids[pairs[r][0] + pairs[r][1]]
            if whole in made or max(made.get(a, -1), made.get(b, -1)) >= r:
                raise ValueError("the merges aren't in the order in which they were made")
            made[whole], self.parts[whole] = r, (a, b)
        self._made = made
        self._follow: dict[tuple[int, int], bool] = {}
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self.by_bytes = {b: i for i, b in self.bytes.items() if i not in self.parts}  # single bytes
        for whole, (a, b) in self.parts.items():  # in the order made: a token whose parts can't stand side by side is never made
            if a in self.bytes and self.by_bytes.get(self.bytes[a]) == a and self.by_bytes.get(self.bytes[b]) == b and self.may_follow(a, b, below=made[whole]):
                self.by_bytes[self.bytes[whole]] = whole
        self.longest = max(map(len, self.by_bytes))
        self._follow.clear()

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The token, then its part on that side, and so on, each with the rank of the merge that ends it."""
        kept = self._left if side == 0 else self._right
        if token not in kept:
            out, end, t = [], float("inf"), token
            while True:
                out.append((t, end))
                if t not in self.parts:
                    break
                end, t = self._made[t], self.parts[t][side]
            kept[token] = out
        return kept[token]

    def may_follow(self, a: int, b: int, below: float = float("inf")) -> bool:
        """Whether text of token a, then b is encoded as just these two, by the merges of a rank under ``below``."""
        rank = self.rank
        for x, x_end in self._spine(a, 1):
            for y, y_end in self._spine(b, 0):
                r = rank.get((x, y))
                if r is not None and r < below and r < x_end and r <= y_end:
                    return False
        return True

    def encode_sorted(self, words: list[bytes]) -> list[list[int]]:
        """Ids of distinct words given in byte order."""
        by_bytes, follow, may, longest = self.by_bytes, self._follow, self.may_follow, self.longest
        if len(follow) > 1 << 21:
            follow.clear()
        out, before = [], b""
        last, size = [0], [0]  # for each depth of the path: the last token of that prefix, and its bytes
        for w in words:
            n, k = len(w), 0
            top = min(n, len(before))
            while k < top and w[k] == before[k]:
                k += 1
            del last[k + 1 :], size[k + 1 :]
            for d in range(k + 1, n + 1):
                for cut in range(max(0, d - longest), d):
                    t = by_bytes.get(w[cut:d])
                    if t is None:
                        continue
                    if cut:
                        pair = (last[cut], t)
                        good = follow.get(pair)
                        if good is None:
                            good = follow[pair] = may(*pair)
                        if not good:
                            continue
                    last.append(t)
                    size.append(d - cut)
                    break
            ids, d = [], n
            while d:
                ids.append(last[d])
                d -= size[d]
            ids.reverse()
            out.append(ids)
            before = w
        return out


class TrieEncoder:
    def __init__(self, path: str, limit: int = 1 << 20):
        import regex

        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(SPLIT.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]"))
        self.table, self.chunks, self.spans = textops.HashTable(limit), Growing(np.int32), Spans()
        self.numbers, self.words = Numbered(), Growing(np.int32)
        names = [self.vocabulary.bytes.get(i, b"") for i in range(self.vocabulary.size)]
        for t, i in self.vocabulary.special.items():
            names[i] = t
        self.names = pa.array(names, pa.large_binary())
        self.decimals = pa.array([f"{i},".encode() for i in range(self.vocabulary.size)], pa.large_binary())
        self.cut = regex.compile("|".join(regex.escape(t.decode()) for t in self.vocabulary.special)) if self.vocabulary.special else None

    @staticmethod
    def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cut before white space that follows something else: no match of the pattern spans such a place."""
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        wide = np.zeros(len(data), bool)  # the last byte of white space outside ASCII
        two, three = data[1:], data[2:]
        wide[1:] |= (data[:-1] == 0xC2) & ((two == 0x85) | (two == 0xA0))
        wide[2:] |= (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3) & ((data[1:-1] & 0xC0) == 0x80) & ((three <= 0x8A) | (three == 0x9F) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = gap[1:] & ~gap[:-1] & ~wide[:-1]
        begins[offsets] = True
        begins[-1] = False
        starts = np.flatnonzero(begins)
        return starts, np.append(starts[1:], len(data))

    def _learn(self, new: list[bytes]) -> None:
        found, counts, special = [], np.zeros(len(new), np.int64), self.vocabulary.special
        findall = self.split.findall
        odd = self.cut if any(t in b"".join(new) for t in special) else None
        for i, raw in enumerate(new):
            text = raw.decode("utf-8", "replace")
            if odd is None:
                got = findall(text)
            else:
                got, at = [], 0
                for m in odd.finditer(text):
                    got += [*findall(text[at : m.start()]), m[0].encode()]  # bytes: a special token
                    at = m.end()
                got += findall(text[at:])
            counts[i] = len(got)
            found += got
        self.numbers.new.clear()
        at = np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
        if pending := self.numbers.new:
            raw = [w if isinstance(w, bytes) else w.encode() for w in pending]
            order = sorted((i for i, w in enumerate(pending) if not isinstance(w, bytes)), key=raw.__getitem__)
            ids: list[list[int]] = [[special[w]] if isinstance(w, bytes) else [] for w in pending]
            for i, got in zip(order, self.vocabulary.encode_sorted([raw[i] for i in order]), strict=True):
                ids[i] = got
            self.words.extend(np.array([t for w in ids for t in w], np.int32), np.array([len(w) for w in ids], np.int64))
        flat, lengths = ragged_take(self.words.flat, self.words.offsets, at)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        self.chunks.extend(flat, np.diff(ends))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, joined, and each document's number of ids."""
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        starts, stops = self.stretches(data, offsets)
        h = textops.hash_spans(data, starts, stops)
        number = self.table.find(h)
        if len(missing := np.flatnonzero(number < 0)):
            fresh, where = np.unique(h[missing], return_index=True)
            if self.table.count + len(fresh) > self.table.limit:
                self.table.clear(), self.chunks.clear(), self.spans.clear(), self.words.clear(), self.numbers.clear()
                missing = np.arange(len(h))
                fresh, where = np.unique(h, return_index=True)
                if len(fresh) > self.table.limit:
                    self.table = textops.HashTable(1 << int(len(fresh)).bit_length())
            where, raw = missing[where], data.tobytes()
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
        return flat, np.diff(ends[np.searchsorted(starts, offsets)])

    def spell(self, flat: np.ndarray, counts: np.ndarray, table: pa.Array) -> list[memoryview]:
        """For each document the joined entries of a table for its ids."""
        got = table.take(pa.array(flat))
        at = np.frombuffer(got.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(counts)])] if len(flat) else np.zeros(len(counts) + 1, np.int64)
        raw = memoryview(got.buffers()[2] or b"")
        return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[str]:
        return [str(b, "utf-8", "replace") for b in self.spell(flat, counts, self.names)]


_encoders: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array<int>) of each whole text."""
    out = "doc_id long, ids array<int>"

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part in text_slices(batch, "text"):
                flat, counts = enc.encode(*text_bytes(part.column("text")))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
                yield pa.record_batch([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the text that the ids (array<int>) of each row spell; null ids spell the empty text."""
    out = "doc_id long, text string"

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            ids = batch.column("ids")
            lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = ids.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            known = (flat >= 0) & (flat < enc.vocabulary.size)
            ends = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(lengths)])]
            yield pa.record_batch([batch.column("doc_id"), pa.array(enc.decode(flat[known], np.diff(ends)), pa.string())], schema=arrow_type(out))

    return encoded.select("doc_id", "ids").mapInArrow(run, out)


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and decode each text in one pass; only digests of the ids and of the decoded text leave the worker."""
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part in text_slices(batch, "text"):
                flat, counts = enc.encode(*text_bytes(part.column("text")))
                ids = [hashlib.sha256(b[:-1]).hexdigest() for b in enc.spell(flat, counts, enc.decimals)]
                text = [hashlib.sha256(t.encode()).hexdigest() for t in enc.decode(flat, counts)]
                yield pa.record_batch([part.column("doc_id"), pa.array(counts), pa.array(ids, pa.string()), pa.array(text, pa.string())], schema=arrow_type(out))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)


def op6_trie_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
