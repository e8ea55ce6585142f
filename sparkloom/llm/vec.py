"""Vectorised word hashing over Arrow string columns (numpy, inside tasks).

A batch of texts is one byte buffer with row offsets.  A word's hash is a polynomial over its
bytes modulo 2**64, taken from prefix sums (the multiplier is odd, hence invertible), and then
mixed; hashes of runs of words are built the same way from the word hashes.  Nothing loops over
words in Python.  Hashes only route or weight rows; whoever needs exactness compares real words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
#: bytes of text that one numpy pass works on (a single longer text is taken whole)
BLOCK_BYTES = 1 << 20

#: separators of the word pattern [^\x20\x09-\x0D]+
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def give_back() -> None:
    """Hand memory that was freed back to the system: a worker goes on to other tasks, and to other stages, with what it holds."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, which hands back its memory when the task ends."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), applied elementwise."""
    h = h ^ U64(salt & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(buf: np.ndarray, off: np.ndarray, is_gap: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row + total) of the words of a block; rows never share a word."""
    gap = np.ones(len(buf) + 2, bool)
    gap[1:-1] = is_gap[buf]
    cut = np.zeros(len(buf) + 2, bool)
    cut[off + 1] = True  # a row starts here
    start = np.flatnonzero(~gap[1:-1] & (gap[:-2] | cut[1:-1]))
    end = np.flatnonzero(~gap[1:-1] & (gap[2:] | cut[2:])) + 1
    return start, end, np.searchsorted(start, off)


class _Powers:
    """Powers of the multiplier and of its inverse, grown when a longer block comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            full = np.full(n, _MUL, U64)
            full[0] = 1
            self.up = np.cumprod(full, dtype=U64)
            full[1:] = _INV
            self.down = np.cumprod(full, dtype=U64)
        return self.up, self.down


_powers = _Powers()


def run_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, independent of the place."""
    up, down = _powers.get(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64) * up[: len(values)], out=total[1:])
    return (total[end] - total[start]) * down[start]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(run_sums(buf.astype(U64) + U64(1), start, end) + (end - start).astype(U64))


def gram_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (runs over row ends included)."""
    if len(h) < k:
        return np.zeros(0, U64)
    at = np.arange(len(h) - k + 1)
    return mix(run_sums(h, at, at + k), 0x51ED270B + salt)


def row_of_word(first: np.ndarray) -> np.ndarray:
    """Row number of each word. first: words()[2]."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
