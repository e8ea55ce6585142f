"""Nearest neighbours by inner product over additive codes.

A vector is coded as the sum of one entry from each of ``BOOKS`` full-dimensional codebooks, trained
one after the other on what is left of a bounded sample (``TRAIN_ROWS`` rows by hash) and chosen for
each vector by beam search.  Its norm over the coded norm is stored with the codes.  All vectors are coded.

Vectors are coded in the unit of their own length, so any finite magnitude does; lengths are kept
as shares of the table's largest component.

Search.  The codes are dealt evenly into files.  Queries go to all executors in batches of bounded
bytes; a task streams its codes past them, ``BLOCK`` rows at a time.  A query's products with all
codebook entries make a lookup table; a row's approximate score is a sum of ``BOOKS`` table entries
times its length.  The best ``SHORT`` of a block are scored exactly on the original vectors in double
precision; a task keeps and gives each query's k nearest, and the k nearest of those are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import in_batches, materialize, partitions, rounds

BOOKS, ENTRIES, BEAM = 16, 256, 4
TRAIN_ROWS = 8192
BLOCK, SHORT = 16_384, 400


def usable(v: Column) -> Column:
    """Not null, not all zero, no null or non-finite component."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def train(sample: np.ndarray, books: int = BOOKS, entries: int = ENTRIES) -> np.ndarray:
    """books x entries x dimension."""
    rng = np.random.default_rng(5)
    rest, out = sample.astype(np.float32), []
    for _ in range(books):
        book = _kmeans(rest, min(entries, len(rest)), rng)
        out.append(book)
        rest = rest - book[(rest @ book.T - 0.5 * (book * book).sum(1)).argmax(1)]
    return np.stack(out)


def lengths(v: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length 1 as floats, their lengths over the largest component), without overflow."""
    v = v.astype(np.float64)
    m = np.abs(v).max(1, keepdims=True)
    u = v / m
    n = np.sqrt((u * u).sum(1))
    return (u / n[:, None]).astype(np.float32), m[:, 0] / largest * n


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norm over coded norm) by beam search over the codebooks."""
    n, (m, k, _) = len(x), books.shape
    rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for book in books:
        left = (rest * rest).sum(2)[:, :, None] - 2 * rest @ book.T + (book * book).sum(1)
        wide = min(beam, left.shape[1] * k)
        pick = np.argpartition(left.reshape(n, -1), wide - 1, axis=1)[:, :wide]
        path, entry = pick // k, pick % k
        rest = np.take_along_axis(rest, path[:, :, None], 1) - book[entry]
        codes = np.concatenate([np.take_along_axis(codes, path[:, :, None], 1), entry[:, :, None].astype(np.uint8)], 2)
    best = (rest * rest).sum(2).argmin(1)
    at = np.arange(n)
    coded = np.linalg.norm(x - rest[at, best], axis=1)
    return codes[at, best], (np.linalg.norm(x, axis=1) / np.maximum(coded, 1e-20)).astype(np.float32)


def _vectors(col: pa.Array, n: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _encode_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, largest = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                unit, size = lengths(_vectors(part.column(1), part.num_rows), largest)
                codes, scale = encode(unit, books)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale * size)], ["vec_id", "v", "code", "scale"])

    return run


def shortlist(score: np.ndarray, size: int) -> np.ndarray:
    """Columns of the ``size`` largest of each row; of equal ones the first."""
    n = score.shape[1]
    if size >= n:
        return np.broadcast_to(np.arange(n), score.shape)
    edge = -np.partition(-score, size - 1, axis=1)[:, size - 1 : size]
    above = score > edge
    equal = score == edge
    take = above | (equal & (np.cumsum(equal, axis=1) <= size - above.sum(1, keepdims=True)))
    return np.nonzero(take)[1].reshape(len(score), size)


class Best:
    """The k best (score, id) of each query so far: higher scores first, NaN last, ties to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.missing = np.ones((queries, k), bool)
        self.score, self.ids = np.zeros((queries, k)), np.zeros((queries, k), np.int64)

    def add(self, of: slice, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        score, ids, missing = (np.concatenate([old[of], new], 1) for old, new in ((self.score, score), (self.ids, ids), (self.missing, missing)))
        order = np.lexsort((ids, np.where(np.isnan(score), np.inf, -score), missing), axis=1)[:, : self.k]
        self.score[of], self.ids[of], self.missing[of] = (np.take_along_axis(x, order, 1) for x in (score, ids, missing))

    def rows(self, qids: np.ndarray) -> pa.RecordBatch:
        ok = ~self.missing
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, ok.sum(1))), pa.array(self.ids[ok]), pa.array(self.score[ok])], ["query_id", "vec_id", "score"])


def _search_rows(shared, k: int, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, qids, q, unit = shared.value
        best = Best(len(qids), k)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                ids, v = part.column(0).to_numpy(), _vectors(part.column(1), part.num_rows)
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(ids), len(books))
                scale = part.column(3).to_numpy()
                for at in range(0, len(qids), 64):
                    of = slice(at, at + 64)
                    table = np.einsum("qd,mkd->mqk", unit[of], books, optimize=True)
                    score = np.zeros((len(qids[of]), len(ids)), np.float32)
                    for m in range(len(books)):
                        score += table[m][:, codes[:, m]]
                    score = score * scale
                    own = qids[of, None] == ids
                    score[own] = -np.inf
                    near = shortlist(score, max(short, k + 1))
                    with np.errstate(over="ignore", invalid="ignore"):
                        exact = np.einsum("qrd,qd->qr", v[near].astype(np.float64), q[of].astype(np.float64))
                    best.add(of, exact, ids[near], np.take_along_axis(own, near, 1))
        yield best.rows(qids)

    return run


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", short: int = SHORT) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest among all other ids (all, if fewer).

    Queries are the rows whose id is divisible by ``every``.  Nearest first, ties to the smaller id.
    Rows with a null id, and vectors that are null, zero, of another than the most common length, or
    hold null or non-finite components take no part.  A repeated row is a candidate as often as it
    stands, but never for a query of its own id; a repeated query counts once.  Products too large for
    a double are infinite, undefined ones (NaN) come last.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    # exact scores are of the given numbers: floats stay floats, all else becomes doubles
    kind = "float" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "double"
    src = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    sizes = src.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("count"), F.max(F.array_max(F.transform("v", F.abs))).cast("double").alias("largest")).orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    src = src.filter(F.size("v") == sizes["d"])
    sample = np.array([r[0] for r in src.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAIN_ROWS).select("v").collect()], np.float64)
    books = train(lengths(sample, sizes["largest"])[0])
    shared = spark.sparkContext.broadcast((books, sizes["largest"]))
    dealt = src.repartition(min(max(partitions(spark), sizes["count"] // BLOCK + 1), sizes["count"] // 256 + 1))
    coded = materialize(dealt.mapInArrow(_encode_rows(shared), f"vec_id long, v array<{kind}>, code binary, scale double"))
    asked = materialize(coded.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).select("vec_id", "v"))
    found = []
    for batch in in_batches(asked, "vec_id", 12.0 * sizes["d"] + 24 * k):
        q = _vectors(batch.column("v").combine_chunks(), batch.num_rows)
        queries = spark.sparkContext.broadcast((books, batch.column("vec_id").to_numpy(), q, lengths(q, sizes["largest"])[0]))
        near = coded.mapInArrow(_search_rows(queries, k, short), "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score")).desc(), F.isnan("score"), "vec_id")
        found.append(near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    return rounds(found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
