"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lowered.  Features are hashed to
``2**BITS`` places: words, pairs of neighbours, and pairs with one word between; a feature counts once
for a text.  Each coordinate has its own rate (from its summed squared gradients), and L1 keeps most
weights at zero, so the model is a short list of places and weights that is sent to all tasks.

Training takes at most ``TRAIN_ROWS`` labelled rows with ``TRAIN_FEATURES`` features in all (both in expectation;
chosen by hash, whole texts) in a fixed order, in one task that holds their feature lists: at most 256 MiB, and
4 MiB for one text, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import vec
from sparkloom.llm.common import materialize, small_or_shuffled

BITS = 20
TRAIN_ROWS, TRAIN_FEATURES = 12_000, 1 << 26
EPOCHS = 5
#: L1 is this times the root of the number of training rows, as noise in summed gradients grows
ALPHA, BETA, L1_RATE, L2 = 1.0, 1.0, 0.055, 0.0
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def places(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every feature occurrence of a block."""
    buf = _FOLD[buf]
    ws, we, first = vec.words(buf, off, _GAP)
    row = vec.row_of_word(first)
    h = vec.word_hashes(buf, ws, we)
    rows, out = [row], [h]
    for gap in (1, 2):
        n = max(len(h) - gap, 0)
        same = row[:n] == row[gap:]
        pair = vec.mix(h[:n] * np.uint64(0x9DDFEA08EB382D69) + h[gap:], gap)
        rows.append(row[:n][same])
        out.append(pair[same])
    return np.concatenate(rows), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, label, sorted distinct places) of (order, label, text)."""
    for batch in batches:
        buf, off = vec.text_buffer(batch.column(2))
        for a, b in vec.blocks(off):
            row, place = places(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            both = np.unique(row.astype(np.int64) << BITS | place)
            ends = np.searchsorted(both, np.arange(b - a + 1, dtype=np.int64) << BITS).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], ["o", "label", "x"])


class Ftrl:
    """FTRL-proximal state for binary features; place 2**BITS is the bias, without L1."""

    def __init__(self, rows: int) -> None:
        self.l1 = L1_RATE * rows**0.5
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, x: np.ndarray, y: int) -> None:
        at = np.append(x, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        x = batch.column(2)
        ends, flat = x.offsets.to_numpy(), x.values.to_numpy()
        rows += [(o, y, flat[a:b].copy()) for o, y, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1], ends[1:])]
    rows.sort(key=lambda r: (r[0], len(r[2]), r[1]))
    model = Ftrl(len(rows))
    for _ in range(EPOCHS):
        for _, y, x in rows:
            model.learn(x, y)
    if rows:
        w = model.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w)
        at = np.unique(np.append(at, 1 << BITS))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], ["place", "w"])


def bounded(feats: DataFrame, most: int) -> DataFrame:
    """Rows of (o, label, x) chosen by the hash of o, with at most ``most`` places in all, in expectation."""
    share = most / (feats.agg(F.sum(F.size("x"))).first()[0] or 1)
    return feats.filter(F.pmod(F.xxhash64("o", F.lit("fits")), F.lit(1 << 30)) < share * (1 << 30))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> dict[int, float]:
    """Non-zero weights by place, the bias at 2**BITS; empty if there is no labelled row."""
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    known = lab.filter(~held_out(F.col("id")))
    share = rows / max(known.count(), 1)
    order = F.xxhash64("id", F.lit(11))
    sample = known.filter(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30)).withColumn("o", order)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small_or_shuffled(sample, sample.count(), 24), "id").select("o", "label", "text")
    feats = materialize(picked.mapInArrow(_features, "o long, label int, x array<int>"))
    return {r[0]: r[1] for r in bounded(feats, TRAIN_FEATURES).coalesce(1).mapInArrow(_fit, "place int, w double").collect()}


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, float] = shared.value
        w = np.zeros(1 << BITS)
        bias = found.get(1 << BITS, 0.0)
        for k, v in found.items():
            if k < 1 << BITS:
                w[k] = v
        used = w != 0
        for batch in batches:
            buf, off = vec.text_buffer(batch.column(1))
            score = np.zeros(batch.num_rows)
            for a, b in vec.blocks(off):
                row, place = places(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                hit = used[place]
                both = np.unique(row[hit].astype(np.int64) << BITS | place[hit])
                score[a:b] = np.bincount(both >> BITS, weights=w[both & ((1 << BITS) - 1)], minlength=b - a)
            score = 1 / (1 + np.exp(-np.clip(score + bias, -35, 35))) if found else score
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted: a row per input row.

    Learns from labels that are 0 or 1 of ids that are not held out.  A null or empty text has no
    features and gets the bias's score; without any labelled row every score is 0.  Labels repeated
    for an id count as often as they stand.  Repeated rows and extra columns change nothing; an empty
    table gives an empty result.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(_score(weights), "doc_id long, held_out boolean, score double, predicted int")
