"""Hard negatives by a vector-approximation file.

A row's components become the integers ``floor(scale * x)``; a score is the integer inner product with an
anchor.  Positives are an anchor's best rows of its own label, negatives the best rows of other labels
whose scores lie in a window below the positive's.

Approximation.  Each dimension is cut into ``CELLS`` cells by quantiles of a bounded sample (``SAMPLE``
rows by hash), closed at both ends by the least and largest component of all rows, and a row keeps a byte
for each dimension.  Looking the bytes up in the table of cell ends gives each component's range; with an
anchor's positive and negative parts these give a lower and an upper bound of the score, which hold for
every row.  Only rows whose bounds can enter a window, and whose upper bound is not below lower bounds
that fill it, are scored exactly.

Anchors go to all executors in batches of bounded bytes; a task streams its rows past them and keeps what
each anchor needs so far: ``positives`` rows in a first pass, ``negatives`` for each positive in a second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import in_batches, materialize, partitions, rounds

SCALE, CELLS, SAMPLE = 256, 64, 8192
#: rows whose bounds are taken at a time, and anchors
BLOCK, ANCHORS = 8192, 32
POSITIVES, NEGATIVES, LEAST, MOST = 5, 3, 50, 95


def cell_edges(sample: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """dimension x (cells + 1): cell c holds the integers from edge c up to the one before edge c + 1."""
    inner = np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="nearest") if len(sample) else np.zeros((0, len(low)))
    return np.concatenate([low[:, None], np.clip(inner.T, low[:, None], high[:, None]), high[:, None] + 1], 1).astype(np.int64)


def quantise(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A byte for each component."""
    return np.stack([np.searchsorted(e[1:-1], c, "right") for e, c in zip(edges, x.T)], 1).astype(np.uint8)


def cell_ends(codes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) component in each row's cells, by lookup."""
    at = np.arange(len(edges))
    return edges[at, codes], edges[at, codes.astype(np.int64) + 1] - 1


class Bounds:
    """Score bounds of a block of rows for any anchors.

    ``most`` is the largest sum of absolute products there can be: sums of integers below 2^24 are exact in
    floats and below 2^53 in doubles; beyond that, the bounds are moved apart by more than the rounding.
    """

    def __init__(self, codes: np.ndarray, edges: np.ndarray, most: float) -> None:
        self.kind = np.float32 if most < 2**24 else np.float64
        self.margin = 0.0 if most < 2**53 else most * 2.0**-44
        low, high = cell_ends(codes, edges)
        self.up = np.concatenate([high, low], 1).astype(self.kind).T
        self.down = np.concatenate([low, high], 1).astype(self.kind).T

    def of(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = np.concatenate([np.maximum(anchors, 0), np.minimum(anchors, 0)], 1).astype(self.kind)
        return parts @ self.down - self.margin, parts @ self.up + self.margin


def _least_of(lower: np.ndarray, k: int) -> float:
    """The k-th largest lower bound, minus infinity if there are fewer."""
    return float(-np.partition(-lower, k - 1)[k - 1]) if len(lower) >= k else -np.inf


def _ints(col: pa.Array, n: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _blocks(batches: Iterator[pa.RecordBatch], edges: np.ndarray, most: float):
    """(ids, labels, vectors, bounds) of ``BLOCK`` rows at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            codes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(part.num_rows, -1)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), _ints(part.column(2), part.num_rows), Bounds(codes, edges, most)


def _code_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = quantise(_ints(batch.column(2), batch.num_rows), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "label", "v", "code"])

    return run


def _positive_rows(shared, k: int):
    """Each anchor's k best rows of its label in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, most, aids, alabels, anchors, _ = shared.value
        found = [[] for _ in aids]
        floor = np.full(len(aids), -np.inf)  # the k-th best score so far
        for ids, labels, v, bounds in _blocks(batches, edges, most):
            for at in range(0, len(aids), ANCHORS):
                lower, upper = bounds.of(anchors[at : at + ANCHORS])
                for i in range(at, min(at + ANCHORS, len(aids))):
                    mine = np.flatnonzero((labels == alabels[i]) & (ids != aids[i]) & (upper[i - at] >= floor[i]))
                    near = mine[upper[i - at, mine] >= _least_of(lower[i - at, mine], k)]
                    if len(near):
                        found[i] = sorted([*found[i], *zip((-(v[near] @ anchors[i])).tolist(), ids[near].tolist())])[:k]
                        floor[i] = -found[i][-1][0] if len(found[i]) == k else -np.inf
        rows = [(a, i, -s) for a, x in zip(aids.tolist(), found) for s, i in x]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["anchor_id", "vec_id", "score"])

    return run


def _negative_rows(shared, k: int, least: int, most_share: int):
    """Of each anchor and positive the k best rows of other labels in the window, in this task.

    An anchor's windows are ordered by place; window j holds scores s with least * p <= 100 * s <= most_share * p.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, most, aids, alabels, anchors, scores = shared.value
        found = [[[] for _ in p] for p in scores]
        for ids, labels, v, bounds in _blocks(batches, edges, most):
            for at in range(0, len(aids), ANCHORS):
                lower, upper = bounds.of(anchors[at : at + ANCHORS])
                for i in range(at, min(at + ANCHORS, len(aids))):
                    low, up = lower[i - at], upper[i - at]
                    other = labels != alabels[i]
                    exact: dict[int, int] = {}
                    for j, p in enumerate(scores[i]):
                        lo, hi = -(-least * p // 100), most_share * p // 100
                        if lo > hi:
                            continue
                        kept = found[i][j]
                        may = np.flatnonzero(other & (up >= max(lo, -kept[-1][0] if len(kept) == k else lo)) & (low <= hi))
                        if not len(may):
                            continue
                        sure = low[may][(low[may] >= lo) & (up[may] <= hi)]
                        near = may[up[may] >= _least_of(sure, k)]
                        todo = [x for x in near.tolist() if x not in exact]
                        if todo:
                            exact |= zip(todo, (v[todo] @ anchors[i]).tolist())
                        hits = [(-exact[x], int(ids[x])) for x in near.tolist() if lo <= exact[x] <= hi]
                        if hits:
                            found[i][j] = sorted(kept + hits)[:k]
        rows = [(a, j, i, -s) for a, x in zip(aids.tolist(), found) for j, y in enumerate(x) for s, i in y]
        yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64())))], ["anchor_id", "place", "negative_id", "negative_score"])

    return run


def mine(vectors: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``.  An anchor's positives are its first
    ``positives`` other rows of the same label, higher scores first, ties by the smaller id; for each the
    first ``negatives`` rows of other labels with ``least * p <= 100 * n <= most * p`` are given.
    Rows with a null id or label, and vectors that are null, hold null or non-finite components, are of
    another than the most common length, or whose products would leave 64 bits take no part.  A repeated
    row counts as often as it stands, but never for an anchor of its own id; a repeated anchor counts
    once, with its smallest label and vector.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    v = F.col(vector_col)
    ok = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    src = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ok)
    # a sum of d products of components up to 2^31 / sqrt(d) fits 64 bits
    whole = F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    small = F.forall(v, lambda x: F.abs(x.cast("double")) * SCALE * F.sqrt(F.size(v)) < 2.0**31)
    src = src.filter(small).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"))
    sizes = src.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None or not sizes["d"]:
        return spark.createDataFrame([], schema)
    d, n = sizes["d"], sizes["count"]
    src = src.filter(F.size("v") == d)
    ends = src.agg(*(f(F.col("v")[i]).alias(f"{name}{i}") for i in range(d) for f, name in ((F.min, "a"), (F.max, "b")))).first()
    low, high = (np.array([ends[f"{c}{i}"] for i in range(d)], np.int64) for c in "ab")
    sample = np.array([r[0] for r in src.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()], np.int64)
    edges = cell_edges(sample, low, high)
    bound = float(d) * float(np.maximum(np.abs(low), np.abs(high)).max()) ** 2
    dealt = src.repartition(min(max(partitions(spark), n // BLOCK + 1), n // 256 + 1))
    coded = materialize(dealt.mapInArrow(_code_rows(spark.sparkContext.broadcast(edges)), "vec_id long, label long, v array<long>, code binary"))
    asked = coded.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    asked = materialize(asked)
    found = []
    for batch in in_batches(asked, "vec_id", 8.0 * d + 32 * positives * (1 + negatives)):
        aids, alabels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        anchors = _ints(batch.column("v").combine_chunks(), batch.num_rows)
        first = spark.sparkContext.broadcast((edges, bound, aids, alabels, anchors, None))
        order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
        near = coded.mapInArrow(_positive_rows(first, positives), "anchor_id long, vec_id long, score long")
        best = materialize(near.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < positives))
        # at most ``positives`` scores for each anchor of the batch
        scores = [[] for _ in aids]
        at = {a: i for i, a in enumerate(aids.tolist())}
        for r in best.select("anchor_id", "place", "score").orderBy("anchor_id", "place").toLocalIterator():
            scores[at[r["anchor_id"]]].append(r["score"])
        second = spark.sparkContext.broadcast((edges, bound, aids, alabels, anchors, scores))
        order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
        hard = coded.mapInArrow(_negative_rows(second, negatives, least, most), "anchor_id long, place int, negative_id long, negative_score long")
        hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
        pairs = best.select("anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        found.append(hard.join(pairs, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    return rounds(found) if found else spark.createDataFrame([], schema)
