"""Importance resampling to a target distribution over hashed n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lowered; features are all runs of one to
``max_n`` consecutive words of a text, repeats counted, and a feature's bucket is the CRC32 of its words
joined by one space, modulo the number of buckets.  A bucket's gain is its smoothed log ratio in the
target against the documents.

Suffix arrays.  A block of texts becomes a sequence of word ids (a dictionary of the block's own bytes,
so equal ids are equal words), each text closed by a smallest symbol.  Prefix doubling sorts its suffixes
by their first ``max_n`` words, and comparing neighbours gives their longest common prefixes.  For each n
the suffixes whose neighbours share n words are a run: all occurrences of one n-gram.  It is hashed once
for the run, and the bucket is scattered back to its occurrences, where counts and scores are taken.

Counting and scoring each read the texts once.  Counts are one number for each bucket and task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import vec
from sparkloom.llm.common import materialize
from sparkloom.operators.helpers import global_cumsum

MAX_N, BUCKETS, SHARE, MIN_WORDS, SEED = 2, 10_000, 25, 20, 7
#: bytes of text of one suffix array (a single longer text is taken whole)
BLOCK_BYTES = 4 << 20
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def word_ids(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(id of each word, the words): a dictionary of the bytes buf[start:end]."""
    size = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=size[1:])
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    packed = buf[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(size), pa.py_buffer(packed)]).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist()


def suffix_array(seq: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes sorted by their first ``depth`` symbols or more, and how many each shares with the one before.

    At most ``depth`` are counted, and none from the first zero on, which closes a text.
    """
    rank, size = seq.astype(np.int64), 1
    order = np.argsort(seq, kind="stable") if depth == 1 else None
    while size < depth:
        ahead = np.zeros(len(seq), np.int64)
        ahead[: max(len(seq) - size, 0)] = rank[size:]
        key = rank * (int(ahead.max(initial=0)) + 1) + ahead
        order = np.argsort(key, kind="stable")
        new = np.ones(len(seq), np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(new)
        size *= 2
    lcp, closed = np.zeros(len(seq), np.int64), np.append(seq, np.zeros(depth, seq.dtype))
    same = np.ones(max(len(seq) - 1, 0), bool)
    for i in range(depth):
        a, b = closed[order[:-1] + i], closed[order[1:] + i]
        same &= (a == b) & (a > 0)
        lcp[1:] += same
    return order, lcp


_CRC_BYTE = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)


def _zero_byte(c: np.ndarray) -> np.ndarray:
    """CRCs after one more byte, without that byte's own share."""
    return (c >> np.uint32(8)) ^ _CRC_BYTE[c & np.uint32(255)]


def crc_shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs moved past ``size`` bytes: the CRC of a joined text is that of its first part, moved, xor that of its second.

    The map is linear in the bits, so for each size four tables of 256 entries hold it.
    """
    known, at = np.unique(size, return_inverse=True)
    tables = np.empty((len(known), 4, 256), np.uint32)
    entry = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
    past = 0
    for i, n in enumerate(known.tolist()):
        for _ in range(n - past):
            entry = _zero_byte(entry)
        past = n
        tables[i] = entry
    out = np.zeros(len(crc), np.uint32)
    for byte in range(4):
        out ^= tables[at, byte, (crc >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


def block_buckets(buf: np.ndarray, off: np.ndarray, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of a block of texts, and the words of each row."""
    buf = _LOWER[buf]
    start, end, first = vec.words(buf, off, _GAP)
    rows, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(start):
        ids, words = word_ids(buf, start, end)
        row = vec.row_of_word(first)
        at = np.arange(len(ids)) + row  # a zero after each row
        seq, row_at, left = (np.zeros(len(ids) + len(first) - 1, np.int64) for _ in range(3))
        seq[at], row_at[at], left[at] = ids + 1, row, first[row + 1] - np.arange(len(ids))
        order, lcp = suffix_array(seq, max_n)
        crc, size = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)), np.fromiter(map(len, words), np.int64, len(words))
        spaced, size = crc_shifted(np.full(len(words), zlib.crc32(b" "), np.uint32), size) ^ crc, size + 1
        for n in range(1, max_n + 1):
            whole = left[order] >= n
            where = order[whole]
            if not len(where):
                break
            begin = lcp[whole] < n
            begin[0] = True
            heads = where[begin]  # one occurrence of each n-gram; its hash goes on from that of its first n - 1 words
            last = seq[heads + n - 1] - 1
            hashed = crc[last] if n == 1 else crc_shifted(before[heads], size[last]) ^ spaced[last]
            here = hashed[np.cumsum(begin) - 1]
            before = np.zeros(len(seq), np.uint32)
            before[where] = here
            rows.append(row_at[where])
            out.append(here.astype(np.int64) % buckets)
    return np.concatenate(rows), np.concatenate(out), np.diff(first)


def _count_rows(max_n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            buf, off = vec.text_buffer(batch.column(0))
            for a, b in vec.blocks(off, BLOCK_BYTES):
                total += np.bincount(block_buckets(buf[off[a] : off[b]], off[a : b + 1] - off[a], max_n, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    rows = texts.select(F.col(text_col)).mapInArrow(_count_rows(max_n, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r["bucket"] for r in rows]] = [r["n"] for r in rows]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of each bucket."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def _weigh_rows(shared, max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            buf, off = vec.text_buffer(batch.column(1))
            n, total, words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for a, b in vec.blocks(off, BLOCK_BYTES):
                row, bucket, words[a:b] = block_buckets(buf[off[a] : off[b]], off[a : b + 1] - off[a], max_n, len(gain))
                n[a:b] = np.bincount(row, minlength=b - a)
                total[a:b] = np.bincount(row, gain[bucket], minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def _noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hexadecimal digits of SHA-256 of seed:id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row; rank is null for what isn't drawn.

    weight is the floored mean of the gains of a text's features (0 without any), score adds Gumbel noise
    from the id.  Of the N rows with at least ``min_words`` words the ``floor(share * N / 100)`` highest
    scores are drawn, ties to the smaller id, a null id last.  A null or empty text has no features.
    Repeated rows have equal scores and ranks of their own.  An empty table gives an empty result, an
    empty target gains that only tell rare from common.  Other columns are not read.
    """
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, text_col, max_n, buckets), bucket_counts(target, target_col, max_n, buckets)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_weigh_rows(gain, max_n), "doc_id long, n_words long, n_features long, weight long")
    # the number tells repeated rows apart, so that no range of the order is one key
    scored = materialize(scored.withColumns({"score": F.col("weight") + _noise(F.col("doc_id"), seed), "number": F.monotonically_increasing_id()}))
    fit = scored.filter(F.col("n_words") >= min_words)
    drawn = fit.count() * share // 100
    ranked = global_cumsum(fit.select("doc_id", "score", "number"), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("number")], {"rank": F.lit(1).cast("long")})
    ranked = ranked.filter(F.col("rank") <= drawn).select("number", "rank")
    return scored.join(ranked, "number", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The rows of documents whose id is drawn, all columns; see importance. Rows with a null id are never drawn here, repeated ids stay if one is."""
    drawn = importance(docs, target, share, min_words, max_n, buckets, seed).filter("rank is not null").select("doc_id").distinct()
    return docs.join(drawn, "doc_id", "left_semi")
