"""Vectorised word cutting and hashing over Arrow text buffers.

Words are runs of bytes of one class; all non-ASCII bytes count as word bytes, so cutting the UTF-8 bytes cuts the same words
as cutting the characters. Nothing here works row by row: a slice of some MB of text becomes a few numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20

_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Alphabet:
    """Which bytes make words, and what each byte is read as."""

    is_word: np.ndarray
    fold: np.ndarray
    table: bytes


def _alphabet(word: set[int], lower: bool) -> Alphabet:
    is_word = np.array([c in word for c in range(256)])
    fold = np.array([c + 32 if lower and 65 <= c <= 90 else c for c in range(256)], np.uint8)
    return Alphabet(is_word, fold, bytes(int(fold[c]) if c in word else 32 for c in range(256)))


#: Letters, digits and all that is not ASCII; A-Z read as a-z.
ALNUM = _alphabet({*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)}, lower=True)
#: All but space, tab, line feed, vertical tab, form feed and carriage return, unchanged.
NON_SPACE = _alphabet(set(range(256)) - {32, *range(9, 14)}, lower=False)


@dataclass
class Words:
    """Words of one slice. bounds[d]:bounds[d + 1] are those of document d; start and end are byte places in data."""

    data: np.ndarray
    first: int
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int, j: int) -> bytes:
        """The bytes from word i to word j - 1, with what stands between them."""
        return self.data[self.start[i] : self.end[j - 1]].tobytes()


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about limit bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i, n = 0, len(a)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def cut_words(first: int, data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet, hashed: bool = True) -> Words:
    """Words of a slice, in order; a word never crosses two documents."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(data, first, np.zeros(len(offsets), np.int64), empty, empty, np.zeros(0, np.uint64))
    m = alphabet.is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = m.copy()
    begins[1:] &= ~m[:-1] | edge[1:n]
    ends = m.copy()
    ends[:-1] &= ~m[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(start, offsets)
    return Words(data, first, bounds, start, end, hash_runs(alphabet.fold[data], start, end) if hashed else np.zeros(0, np.uint64))


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], eight bytes at a time over all runs at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    h = (end - start).astype(np.uint64) * _K
    live, at = np.arange(len(start)), start.copy()
    while len(live):
        left = end[live] - at[live]
        x = eights[at[live]].view(np.uint64).ravel()
        short = left < 8
        x[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[live] = mix(h[live] * _K + x + np.uint64(1))
        at[live] += 8
        live = live[left > 8]
    return h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words for each place that has them, whatever document they are of (see inside)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g = g * _K + h[k : len(h) - n + 1 + k]
    return mix(g)


def inside(bounds: np.ndarray, n: int) -> np.ndarray:
    """Whether n words from each place lie in one document; as long as grams(h, n)."""
    total = int(bounds[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):  # a document may be shorter than n: every edge spoils the n - 1 places before it
        at = bounds[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def batches(iterator: Iterator[pa.RecordBatch], alphabet: Alphabet, column: str = "text", hashed: bool = True) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Rows and words, slice by slice."""
    for batch in iterator:
        for first, data, offsets in slices(batch.column(batch.schema.get_field_index(column))):
            yield batch.slice(first, len(offsets) - 1), cut_words(first, data, offsets, alphabet, hashed)
