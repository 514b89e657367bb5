"""Whole-column text primitives on numpy arrays: word spans, word hashes and word n-gram hashes for thousands of documents at once.

All functions work on the UTF-8 bytes of a slice of documents, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from treegrain.session import tidy  # noqa: F401

#: Bytes of text that are worked on at once; arrays of 8 bytes per byte of text stay in the CPU's cache and far below a worker's memory.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_WORD_INVERSE = np.uint64(pow(int(_WORD_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        m = max(n + n // 8, SLICE_BYTES + SLICE_BYTES // 8)
        got = np.full(m, base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= 8 * SLICE_BYTES:
            _powers[int(base)] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most `limit` bytes of text each (one row, if it alone is longer)."""
    _, at = raw(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """The words (maximal runs of bytes other than space and \\t..\\r) of a run of documents.

    starts, ends: byte spans; doc: row of each word; first: index of the first word of each row (with one more at the end).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        if n == 0:
            self.starts = self.ends = self.doc = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        black = ~WHITE[data]
        begin, end = black.copy(), black.copy()
        begin[1:] &= ~black[:-1]
        end[:-1] &= ~black[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begin[inner] = black[inner]
        end[inner - 1] = black[inner - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (of `data`, if given: other bytes at the same places)."""
        return span_hashes(self.data if data is None else data, self.starts, self.ends)


def prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: prefix(data)[i] covers data[:i]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, running: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    h = prefix(data) if running is None else running
    return mix((h[ends] - h[starts]) * powers(INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_prefix(words: np.ndarray) -> np.ndarray:
    """Running polynomial hash over word hashes."""
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_WORD_BASE, len(words)), out=out[1:])
    return out


def sequence_hashes(running: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of words, from word_prefix(); other seeds give other finishes of the same sum."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    x = (running[ends] - running[starts]) * powers(_WORD_INVERSE, len(running))[starts]
    return mix(x + np.uint64(seed) + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each place (the last n - 1 places are left out)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out *= _WORD_BASE
        out += words[j : j + m]
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` consecutive values."""
    if len(x) < width:
        return x[:0]
    m, have = x, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(x) - width + 1], m[width - have : width - have + len(x) - width + 1])
    return m


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return x.astype(np.uint64, copy=False).view(np.int64)
