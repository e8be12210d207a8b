"""Vectorised work on the UTF-8 bytes of many documents: words, word hashes, windows, a hash table."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> _U(30))) * _K2
    h = (h ^ (h >> _U(27))) * _K3
    return h ^ (h >> _U(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each document, and for each document the index of its first word."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    full = ~gap
    begins = full.copy()
    begins[1:] &= gap[:-1]
    ends = full.copy()
    ends[:-1] &= gap[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = full[inner]
    ends[inner - 1] = full[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes a step; never 0."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(shape=(len(data) + 8,), dtype="<u8", buffer=padded, strides=(1,))
    left = stops - starts
    h = mix(left.astype(np.uint64) + _K1)
    which, at = np.arange(len(starts)), starts
    while len(which):
        rest = left[which]
        block = eight[at]
        short = rest < 8
        block[short] &= (_U(1) << (rest[short].astype(np.uint64) * _U(8))) - _U(1)
        h[which] = mix((h[which] ^ block) * _K1 + _K2)
        more = rest > 8
        which, at = which[more], at[more] + 8
        left[which] -= 8
    h[h == 0] = 1
    return h


def windows(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word windows that stay within a document, and the index of each window's first word."""
    n = len(h)
    if n < size:
        return h[:0], np.empty(0, np.int64)
    acc = h[: n - size + 1].copy()
    for k in range(1, size):
        acc = mix(acc * _K1 + h[k : n - size + 1 + k])
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = owner[: n - size + 1] == owner[size - 1 :]
    return acc[inside], np.flatnonzero(inside)


class HashTable:
    """From 64-bit hashes (not 0) to dense numbers, open addressing, all of an array at once. It forgets everything beyond ``limit`` entries."""

    def __init__(self, limit: int = 1 << 20):
        self.limit, self.count = limit, 0
        self.mask = _U(4 * limit - 1)
        self.keys, self.values = np.zeros(4 * limit, np.uint64), np.zeros(4 * limit, np.int32)

    def clear(self) -> None:
        self.count = 0
        self.keys[:] = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        which, slot = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(which):
            there = self.keys[slot]
            hit = there == h[which]
            out[which[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            which, slot = which[on], (slot[on] + 1) & int(self.mask)
        return out

    def skip(self, n: int) -> np.ndarray:
        """Numbers for n entries that no hash finds."""
        self.count += n
        return np.arange(self.count - n, self.count, dtype=np.int32)

    def add(self, h: np.ndarray) -> None:
        """Number new, distinct hashes in their order."""
        number = np.arange(self.count, self.count + len(h), dtype=np.int32)
        self.count += len(h)
        which, slot = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(which):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[which[free]]
            won = self.keys[slot] == h[which]
            self.values[slot[won]] = number[which[won]]
            which, slot = which[~won], (slot[~won] + 1) & int(self.mask)


def squeeze(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def unsqueeze(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys: their differences, squeezed."""
    return squeeze(np.diff(keys, prepend=_U(0)).astype("<u8"))


def unpack_keys(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unsqueeze(raw, "<u8"), dtype=np.uint64)
