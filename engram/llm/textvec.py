"""Words, word hashes and shingles of an Arrow batch of texts, as numpy arrays over the batch's bytes.

Everything works on UTF-8 bytes: the token classes below only name ASCII bytes, and every byte of a
longer code point is 0x80 or more, so a byte is inside a word exactly when its code point is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone and whole.
CHUNK = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of the base, or of its inverse, modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        out = np.full(max(n, CHUNK + 1), step, dtype=np.uint64)
        out[0] = 1
        have = _powers[kind] = np.multiply.accumulate(out)
    return have[:n]


class Block:
    """The words of some texts. doc: text number of each word; start, end: bytes; h: hash; first: word number at which each text begins (one more at the end)."""

    def __init__(self, texts: pa.Array, inside: np.ndarray, lower: bool = True):
        texts = pc.fill_null(texts, "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=kind, count=n + 1 + texts.offset)[texts.offset :].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        self.n, self.at = n, offsets - offsets[0]
        self.raw, self.bytes = data, _LOWER[data] if lower else data
        m = inside[self.bytes]
        before = np.empty_like(m)
        if len(m):
            before[0] = False
            before[1:] = m[:-1]
            inner = self.at[:-1][self.at[:-1] < len(m)]
            before[inner] = False
            self.start = np.flatnonzero(m & ~before)
            after = np.empty_like(m)
            after[-1] = False
            after[:-1] = m[1:]
            after[inner[inner > 0] - 1] = False
            self.end = np.flatnonzero(m & ~after) + 1
        else:
            self.start = self.end = np.empty(0, dtype=np.int64)
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        up = _BYTE[self.bytes]
        up *= _power("up", len(up))
        total = np.zeros(len(up) + 1, dtype=np.uint64)
        np.cumsum(up, out=total[1:])
        self._total = total
        self.h = self._hash(self.start, self.end)

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.empty(0, np.uint64)
        return mix((self._total[end] - self._total[start]) * _power("down", len(self._total))[start])

    def prefixes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word of at least `length` bytes, and the hash of its first bytes (other than that of a word)."""
        at = np.flatnonzero(self.end - self.start >= length)
        start = self.start[at]
        return at, mix(self._hash(start, start + length) + np.uint64(length))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of k words of one text, and the word number at which it begins."""
        h = self.h
        if len(h) < k:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        out = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += h[i : len(h) - k + 1 + i]
        at = np.flatnonzero(self.doc[: len(out)] == self.doc[k - 1 :])
        return mix(out[at]), at

    def word(self, i: int) -> str:
        return self.bytes[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def whole(h: np.ndarray) -> int:
    """One hash of a short sequence of word hashes."""
    x = len(h)
    for v in h.tolist():
        x = (x * 0xD6E8FEB86659FD93 + v) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([x], dtype=np.uint64))[0])


def shingle_sets(block: Block, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text; one of the whole sequence if it is shorter; none if it has no words."""
    grams, at = block.grams(k)
    cut = np.searchsorted(at, block.first)
    for i in range(block.n):
        a, b = block.first[i], block.first[i + 1]
        if b - a >= k:
            yield np.unique(grams[cut[i] : cut[i + 1]])
        elif b > a:
            yield np.array([whole(block.h[a:b])], dtype=np.uint64)
        else:
            yield np.empty(0, dtype=np.uint64)


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps a Python worker for later tasks, and its heap as large as it was."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `most` bytes of text, or of one row."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
