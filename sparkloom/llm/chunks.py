"""A table of distinct chunks: encode each distinct chunk of a block once, join the ids back by position."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np


class _Numbers(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class ChunkTable:
    """Chunk -> ids, for chunks whose ids do not depend on their neighbours. A chunk is any string key.

    ``encode`` maps a list of keys to a list of id lists; ``note`` maps both to what
    else is kept of each distinct chunk, in ``notes``.  The table holds at most ``limit`` chunks
    and starts anew when it is full, so a worker's memory stays bounded however many chunks come.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], note: Callable[[list[str], list[list[int]]], list] | None = None, limit: int = 300_000) -> None:
        self.encode, self.note, self.limit = encode, note, limit
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = _Numbers()
        self.notes: list = []
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        ids = self.encode(fresh)
        if self.note:
            self.notes += self.note(fresh, ids)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        used, more = int(self.ends[-1]), int(size.sum())
        if used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(more, len(self.flat)), np.uint32)])
        self.flat[used : used + more] = np.fromiter((x for y in ids for x in y), np.uint32, more)
        self.ends = np.concatenate([self.ends, used + np.cumsum(size)])

    def join(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, ids in each row, numbers of all chunks)."""
        if len(self.at) > self.limit:
            self._clear()
        at = self.at
        known = len(at)
        chunks = np.fromiter(map(len, rows), np.int64, len(rows))
        nth = np.fromiter(map(at.__getitem__, chain.from_iterable(rows)), np.int64, int(chunks.sum()))
        if len(at) > known:
            fresh = list(at)[known:]
            self._learn(fresh)
        begin = self.ends[nth]
        size = self.ends[nth + 1] - begin
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(begin - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        stop = np.concatenate([[0], stop])
        last = np.cumsum(chunks)
        return ids, stop[last] - stop[last - chunks], nth
