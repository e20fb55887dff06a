"""Vectorised scanning of UTF-8 text columns: word boundaries and hashes.

Everything works on the raw buffers of an Arrow string array, so that one call
handles a whole slice of documents without a Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the memory of the temporary arrays.
SLICE_BYTES = 1 << 20


def give_back() -> None:
    """Return freed memory to the system, as Python workers wait long between tasks; nothing where the C library can't."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def byte_class(separators: list[tuple[int, int]]) -> np.ndarray:
    """A table over bytes: True where the byte belongs to a word."""
    table = np.ones(256, dtype=bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


#: Words `[^\x20\x09-\x0D]+`.
WHITE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, of text that is already lower case.
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1 << 62, 1 << 63)) * 2 + 1


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _of(base: int, size: int) -> np.ndarray:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        return np.multiply.accumulate(factors)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, min(2 * len(self.up), len(self.up) + SLICE_BYTES))
            self.up, self.down = (self._of(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


#: Tables of powers that a process needs once: of the base for bytes, and of those for words.
_powers: dict[int, _Powers] = {}


def _powers_of(seed: int) -> _Powers:
    if seed not in _powers:
        _powers[seed] = _Powers(_odd(seed))
    return _powers[seed]


class Hasher:
    """Hashes of spans of bytes and of windows of words, from prefix sums.

    Hashers of one `words` seed combine words alike.
    """

    def __init__(self, seed: int, words: int = 2) -> None:
        self.table = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.bytes, self.words = _powers_of(1), _powers_of(words)

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = self.bytes.get(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * up[:-1], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start])

    def windows(self, words: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hash of words[start : start + length] for each start."""
        up, down = self.words.get(len(words) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[:-1], out=sums[1:])
        return mix((sums[start + length] - sums[start]) * down[start])


@dataclass
class Words:
    """Words of a slice of documents.

    data: the bytes of the slice (lower case, if asked for); start, end: the words'
    bytes; first: index of each document's first word, and of the end.
    """

    low: int
    high: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def docs(self) -> int:
        return self.high - self.low

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len + 1 offsets of an Arrow string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes; a longer document stands alone."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def scan(texts: pa.Array, table: np.ndarray = WHITE, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of all texts, slice by slice."""
    data, offsets = buffers(texts)
    for low, high in slices(offsets, limit):
        part = data[offsets[low] : offsets[high]]
        if lower:
            part = LOWER[part]
        edges = offsets[low : high + 1] - offsets[low]
        inside = table[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        at = edges[:-1][edges[:-1] < edges[1:]]  # first bytes of documents
        begins[at] |= inside[at]
        last = edges[1:][edges[:-1] < edges[1:]] - 1
        ends[last] |= inside[last]
        start = np.flatnonzero(begins)
        yield Words(low, high, part, start, np.flatnonzero(ends) + 1, np.searchsorted(start, edges))


def window_starts(first: np.ndarray, width: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start word, length and document of each window of `width` words.

    short: a document of fewer words, but not none, is one window.
    """
    counts = np.diff(first)
    n = np.maximum(counts - width + 1, 0)
    if short:
        n = np.where((n == 0) & (counts > 0), 1, n)
    doc = np.repeat(np.arange(len(counts)), n)
    ahead = np.cumsum(n) - n
    start = np.arange(len(doc)) - ahead[doc] + first[:-1][doc]
    return start, np.minimum(width, counts[doc]), doc
