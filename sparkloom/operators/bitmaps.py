"""Rows that differ least from given rows, by counting bits of bitmaps.

A block of tuples keeps, for each column, where each value stands: a bitmap for values of many rows, a list
of places for the others.  For a batch of targets a column's bitmaps say 64 rows at a time which differ;
carry-save counters add the columns up, and the counters' bits, from the highest down, leave the rows
that differ least.  No set of columns is ever listed, and nothing grows with more than targets times rows / 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.helpers import in_batches

#: tuples of a block, targets at a time
BLOCK, TARGETS = 16_384, 64
#: rows of a value in a block from which it has a bitmap
DENSE = 64
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


class Block:
    def __init__(self, cols: list[pa.Array], n: np.ndarray) -> None:
        self.rows = len(n)
        self.words = -(-self.rows // 64)
        self.weight = np.zeros(self.words * 64)
        self.weight[: self.rows] = n
        self.weight = self.weight.reshape(self.words, 64)
        self.valid = np.full(self.words, _ALL)
        if self.rows % 64:
            self.valid[-1] = (_ONE << np.uint64(self.rows % 64)) - _ONE
        self.values, self.places, self.bounds, self.dense, self.maps = [], [], [], [], []
        for col in cols:
            found = col.dictionary_encode()
            code = found.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            bounds = np.searchsorted(code[order], np.arange(len(found.dictionary) + 1))
            many = np.flatnonzero(np.diff(bounds) >= DENSE)
            maps = np.zeros((len(many), self.words), np.uint64)
            for i, v in enumerate(many.tolist()):
                at = order[bounds[v] : bounds[v + 1]]
                np.bitwise_or.at(maps[i], at >> 6, _ONE << (at & 63).astype(np.uint64))
            dense = np.full(len(found.dictionary) + 1, -1)  # the last is that of a value the block hasn't got
            dense[many] = np.arange(len(many))
            for held, x in ((self.values, found.dictionary), (self.places, order), (self.bounds, np.append(bounds, bounds[-1])), (self.dense, dense), (self.maps, maps)):
                held.append(x)

    def codes(self, cols: list[pa.Array]) -> list[np.ndarray]:
        """Of targets' values, the block's own codes."""
        return [pc.fill_null(pc.index_in(c, value_set=v), len(v)).to_numpy(zero_copy_only=False).astype(np.int64) for c, v in zip(cols, self.values)]

    def _agree(self, c: int, want: np.ndarray) -> np.ndarray:
        """targets x words: the rows with the wanted value of column c."""
        out = np.zeros((len(want), self.words), np.uint64)
        dense = self.dense[c][want]
        out[dense >= 0] = self.maps[c][dense[dense >= 0]]
        few = np.flatnonzero(dense < 0)
        begin, size = self.bounds[c][want[few]], self.bounds[c][np.minimum(want[few] + 1, len(self.bounds[c]) - 1)] - self.bounds[c][want[few]]
        row = np.repeat(few, size)
        at = self.places[c][np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)]
        np.bitwise_or.at(out, (row, at >> 6), _ONE << (at & 63).astype(np.uint64))
        return out

    def look(self, want: list[np.ndarray], closed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each target: weight of the rows that differ on no open column; least number of open columns that
        another row differs on (0: there is none); those columns, of equally many the first.

        closed: targets x columns.
        """
        p, n = len(want), len(closed)
        count = [np.zeros((n, self.words), np.uint64) for _ in range(p.bit_length())]
        differs = []
        for c in range(p):
            diff = ~self._agree(c, want[c]) & self.valid & np.where(closed[:, c], np.uint64(0), _ALL)[:, None]
            differs.append(diff)
            carry = diff
            for b in range(min(len(count), (c + 1).bit_length())):
                count[b], carry = count[b] ^ carry, count[b] & carry
        alive = np.zeros((n, self.words), np.uint64)
        for x in count:
            alive |= x
        q, w = np.nonzero(self.valid & ~alive)
        bits = np.unpackbits((self.valid & ~alive)[q, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hits = np.bincount(q, (bits * self.weight[w]).sum(1), n)
        least = np.zeros(n, np.int64)
        some = alive.any(1)
        for b in reversed(range(len(count))):
            fewer = alive & ~count[b]
            has = fewer.any(1)
            alive = np.where(has[:, None], fewer, alive)
            least += (some & ~has).astype(np.int64) << b
        mask = np.zeros((n, p), bool)
        for c in range(p):
            with_it = alive & differs[c]
            mask[:, c] = with_it.any(1)
            alive = np.where(mask[:, c, None], with_it, alive)
        return hits, least, mask


def _look_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, targets, closed = shared.value
        n, p = closed.shape
        hits, least, mask = np.zeros(n), np.zeros(n, np.int64), np.zeros((n, p), bool)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                block = Block(part.columns[1:], part.column(0).to_numpy())
                codes = block.codes(targets)
                for at in range(0, n, TARGETS):
                    of = slice(at, at + TARGETS)
                    h, d, m = block.look([c[of] for c in codes], closed[of])
                    hits[of] += h
                    # fewer columns first, then the one whose first differing column comes first
                    tie = (d > 0) & (d == least[of])
                    first = (m != mask[of]).argmax(1)
                    ahead = tie & np.take_along_axis(m, first[:, None], 1)[:, 0] & (m != mask[of]).any(1)
                    take = (d > 0) & ((least[of] == 0) | (d < least[of])) | ahead
                    least[of], mask[of] = np.where(take, d, least[of]), np.where(take[:, None], m, mask[of])
        # sorts like the order above: 0 stands for a column that differs
        text = [bytes(x).decode() for x in np.where(mask, ord("0"), ord("1")).astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hits), pa.array(np.where(least > 0, least, p + 1)), pa.array(text)], ["id", "hits", "least", "others"])

    return run


def nearest(tuples: DataFrame, targets: DataFrame, cols: list[str]) -> list[DataFrame]:
    """id, hits, least, others of each target, batch by batch: see Block.look, over all tuples (n, cols as text without nulls).

    targets: a written table of id, cols and closed, a text with 1 for each column that doesn't count.
    others has 0 for each column to close next; least is the number of columns plus 1 if no row differs.
    """
    spark = tuples.sparkSession
    rows = tuples.select(F.col("n").cast("double").alias("n"), *cols)
    out = []
    for batch in in_batches(targets, "id", 24.0 * len(cols)):
        closed = np.array([[x == "1" for x in t] for t in batch.column("closed").to_pylist()], bool).reshape(batch.num_rows, len(cols))
        shared = spark.sparkContext.broadcast((batch.column("id").to_numpy(), [batch.column(c).combine_chunks() for c in cols], closed))
        met = rows.mapInArrow(_look_rows(shared), "id long, hits double, least long, others string")
        out.append(met.groupBy("id").agg(F.sum("hits").cast("long").alias("hits"), F.min(F.struct("least", "others")).alias("b")).select("id", "hits", "b.least", "b.others"))
    return out
