"""Many logistic regressions at a time: models over subsets of features and of rows share every pass over the table."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.helpers import global_cumsum, materialize

#: Newton steps at most, and the gain of mean log-likelihood that ends them
STEPS, GAIN = 30, 1e-12
#: rows that a task computes at a time
ROWS = 1 << 14
#: rows times models that it computes at a time
CELLS = 1 << 17
#: scores of a model in a slice, which one task puts in order, and rows of the sample behind each cut between slices
SLICE, CUT_ROWS = 1 << 21, 64
#: scores that a task gathers before it deals them to slices
GATHERED = 1 << 21


class Model(NamedTuple):
    """A logistic regression on the features with a 1 in mask, fitted to the rows whose folds[rep] is not fold (rep None: all rows)."""

    mask: tuple[int, ...]
    rep: int | None = None
    fold: int = 0


def prepared(df: DataFrame, features: list[str], label: str, folds: str | None = None) -> DataFrame:
    """x (array of features as doubles, null where null or NaN), y, folds; rows without a label are left out."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.filter(F.col(label).isNotNull()).select(F.array(*map(number, features)).alias("x"), F.col(label).cast("double").alias("y"), (F.col(folds) if folds else F.array().cast("array<int>")).alias("folds"))


def _blocks(batches: Iterator[pa.RecordBatch], center: np.ndarray, scale: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Standardised features with a leading 1 (NaN where missing), labels and folds, ROWS rows at a time."""
    for batch in batches:
        for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
            n = part.num_rows
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, len(center))
            folds = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            yield np.column_stack([np.ones(n), (x - center) / scale]), part.column(1).to_numpy(zero_copy_only=False), folds


def _rows_of(m: Model, x: np.ndarray, folds: np.ndarray, used: np.ndarray, held: bool) -> np.ndarray:
    """Rows that the model is fitted to, or (held) those that it is tested on; rows that miss a feature of it are neither."""
    known = ~np.isnan(x[:, used]).any(axis=1)
    return known if m.rep is None else known & ((folds[:, m.rep] == m.fold) == held)


def _fitted(models: list[Model], x: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """rows x models: whether the model is fitted to the row (_rows_of of each)."""
    out = np.ones((len(x), len(models)), bool)
    missing = np.isnan(x)
    if missing.any():
        asked = np.array([(1, *m.mask) for m in models], float).T
        out = missing.astype(float) @ asked == 0
    for j, m in enumerate(models):
        if m.rep is not None:
            out[:, j] &= folds[:, m.rep] != m.fold
    return out


def _used(m: Model) -> np.ndarray:
    return np.flatnonzero([1, *m.mask])


class Fits(NamedTuple):
    models: list[Model]
    weights: list[np.ndarray]
    center: np.ndarray
    scale: np.ndarray


def fit(rows: DataFrame, models: list[Model]) -> Fits:
    """All models (of prepared rows) by Newton steps: one pass and one aggregate a step, however many models there are.

    A task adds up each model's log-likelihood, gradient and Hessian over its rows; their sums are (features + 1)^2 numbers a
    model.  A step that loses likelihood is halved.  Features are standardised for the arithmetic only; directions that the
    rows leave open (constant or repeated features) get weight 0.  A model without rows has weights of 0.  Classes that a
    line separates have no finite best weights; their models stop at a likelihood of nearly 1 or after STEPS passes.
    """
    d = len(models[0].mask) if models else 0
    number = [F.element_at("x", i + 1) for i in range(d)]
    ends = rows.agg(F.count("*"), *(f(x) for f in (F.avg, F.stddev_pop) for x in number)).first()
    center = np.array([x or 0.0 for x in ends[1 : d + 1]])
    scale = np.array([x or 1.0 for x in ends[d + 1 :]])
    used = [_used(m) for m in models]
    at = [np.zeros(len(u)) for u in used]
    best: list[tuple | None] = [None] * len(models)
    step = [np.zeros(len(u)) for u in used]
    open_ = list(range(len(models)))
    for _ in range(STEPS):
        if not open_:
            break
        asked, weights = list(open_), [at[i] for i in open_]

        def sums(batches: Iterator[pa.RecordBatch], asked: list[int] = asked, weights: list[np.ndarray] = weights) -> Iterator[pa.RecordBatch]:
            w = np.zeros((d + 1, len(asked)))
            for j, (i, own) in enumerate(zip(asked, weights)):
                w[used[i], j] = own
            mine = [models[i] for i in asked]
            ends, slope, bend = np.zeros((2, len(asked))), np.zeros((d + 1, len(asked))), np.zeros((d + 1, d + 1, len(asked)))
            step = max(256, CELLS // len(asked))
            for x, y, folds in _blocks(batches, center, scale):
                for at in range(0, len(y), step):
                    xs, ys = x[at : at + step], y[at : at + step, None]
                    fitted = _fitted(mine, xs, folds[at : at + step]).astype(float)
                    xs = np.nan_to_num(xs, nan=0.0)
                    z = xs @ w
                    e = np.exp(-np.abs(z))
                    q = 1 / (1 + e)
                    p = np.where(z >= 0, q, e * q)
                    ends[0] += fitted.sum(axis=0)
                    ends[1] += (fitted * (ys * z - np.maximum(z, 0) + np.log(q))).sum(axis=0)
                    slope += xs.T @ (fitted * (ys - p))
                    spread = fitted * (e * q * q)
                    for c in range(d + 1):
                        bend[c] += (xs * xs[:, c : c + 1]).T @ spread
            total = [np.concatenate([ends[:, j], slope[used[i], j], bend[np.ix_(used[i], used[i])][:, :, j].ravel()]) for j, i in enumerate(asked)]
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int32()), pa.array(total, pa.list_(pa.float64()))], ["model", "total"])

        parts = rows.mapInArrow(sums, "model int, total array<double>").select("model", F.posexplode("total").alias("i", "v"))
        whole = parts.groupBy("model", "i").agg(F.sum("v").alias("v")).groupBy("model").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("t"))
        found = {r["model"]: np.array([e["v"] for e in r["t"]]) for r in whole.collect()}
        still = []
        for i in asked:
            t = found.get(i)
            if t is None or not t[0]:
                continue
            k, ll = len(used[i]), t[1] / t[0]
            if best[i] is not None and ll < best[i][1] - GAIN:
                step[i] = step[i] / 2
                at[i] = best[i][0] + step[i]
            else:
                done = best[i] is not None and ll - best[i][1] <= GAIN or ll > -1e-9
                best[i] = (at[i], ll)
                if done:
                    continue
                step[i] = np.linalg.pinv(t[2 + k :].reshape(k, k), rcond=1e-12, hermitian=True) @ t[2 : 2 + k]
                at[i] = at[i] + step[i]
            still.append(i)
        open_ = still
    return Fits(models, [b[0] if b else a for a, b in zip(at, best)], center, scale)


def _chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of label 1; column by column, as a matrix product may round equal rows in different ways, and ties count."""
    z = np.zeros(len(x))
    for c, own in enumerate(w):
        z += x[:, c] * own
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def scored(rows: DataFrame, fits: Fits, held: bool = True) -> DataFrame:
    """model (number), y, score of every row that a model is tested on (held: of a model with folds its own fold, else every row)."""
    models, weights, center, scale = fits

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, folds in _blocks(batches, center, scale):
            for i, (m, w) in enumerate(zip(models, weights)):
                used = _used(m)
                mine = _rows_of(m, x, folds, used, held)
                p = _chance(x[mine][:, used], w)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), i, np.int32)), pa.array(y[mine]), pa.array(p)], ["model", "y", "score"])

    return rows.mapInArrow(score, "model int, y double, score double")


def _own_scores(fits: Fits, held: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(model, labels, scores) as scored gives them, block by block."""
    models, weights, center, scale = fits
    for x, y, folds in _blocks(batches, center, scale):
        for i, (m, w) in enumerate(zip(models, weights)):
            used = _used(m)
            mine = _rows_of(m, x, folds, used, held)
            yield i, y[mine], _chance(x[mine][:, used], w)


def held_cindexes(rows: DataFrame, fits: Fits, held: bool = True) -> list[float | None]:
    """cindexes(scored(rows, fits, held)) for labels of 0 and 1, without a row for each score.

    Scores are dealt to slices of about SLICE of them, cut where a sample of the rows says; the sample decides nothing
    else.  A task sends a model's scores for a slice as two sorted arrays, those of ones and of zeros; a slice counts its own
    pairs, ties half, and the pairs between slices follow from their sizes.  Equal scores lie in one slice.
    """
    n = rows.count()
    slices = -(-n // SLICE)
    cuts = [np.zeros(0)] * len(fits.models)
    if slices > 1:
        few = rows.sample(fraction=min(1.0, CUT_ROWS * slices / n), seed=0).toArrow().combine_chunks().to_batches()
        met: list[list[np.ndarray]] = [[np.zeros(0)] for _ in fits.models]
        for i, _, p in _own_scores(fits, held, few):
            met[i].append(p)
        tried = [np.concatenate(m) for m in met]
        cuts = [np.unique(np.quantile(t, np.arange(1, slices) / slices, method="lower")) if len(t) else np.zeros(0) for t in tried]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for i, parts in kept.items():
                y, p = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
                sides = [np.sort(p[y == side]) for side in (1, 0)]
                ends = [[0, *np.searchsorted(s, cuts[i], "right").tolist(), len(s)] for s in sides]
                blobs = [[s[a:b].tobytes() for a, b in zip(e, e[1:])] for s, e in zip(sides, ends)]
                full = [j for j in range(len(cuts[i]) + 1) if blobs[0][j] or blobs[1][j]]
                if full:
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(full), pa.int32()), pa.array(full, pa.int32()), *(pa.array([b[j] for j in full], pa.binary()) for b in blobs)], ["model", "slice", "ones", "zeros"])

        for i, y, p in _own_scores(fits, held, batches):
            kept.setdefault(i, []).append((y, p))
            size += len(y)
            if size >= GATHERED:
                yield from flush()
                kept, size = {}, 0
        yield from flush()

    def count(part: pd.DataFrame) -> pd.DataFrame:
        ones, zeros = (np.sort(np.frombuffer(b"".join(part[c]), np.float64)) for c in ("ones", "zeros"))
        twice = int(np.searchsorted(zeros, ones, "left").sum()) + int(np.searchsorted(zeros, ones, "right").sum())
        return pd.DataFrame({"model": part["model"].iloc[:1], "slice": part["slice"].iloc[:1], "ones": [len(ones)], "zeros": [len(zeros)], "won": [twice / 2]})

    parts = rows.mapInArrow(dealt, "model int, slice int, ones binary, zeros binary").groupBy("model", "slice")
    found: dict[int, list] = {}
    for r in sorted(parts.applyInPandas(count, "model int, slice int, ones long, zeros long, won double").collect(), key=lambda r: (r["model"], r["slice"])):
        ones, zeros, won = found.get(r["model"], (0, 0, 0.0))
        found[r["model"]] = (ones + r["ones"], zeros + r["zeros"], won + r["won"] + r["ones"] * zeros)
    shares = {i: won / (ones * zeros) for i, (ones, zeros, won) in found.items() if ones and zeros}
    return [max(shares[i], 1 - shares[i]) if i in shares else None for i in range(len(fits.models))]


def cindexes(scores: DataFrame, models: int) -> list[float | None]:
    """The c-index of each model (turned over under one half; None without both classes), all from one order of (model, score)."""
    g = scores.groupBy("model", "score").agg(F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("zeros"))
    run = materialize(global_cumsum(g, [F.col("model"), F.col("score")], {"b0": F.col("zeros")}))
    first = run.groupBy("model").agg(F.min(F.col("b0") - F.col("zeros")).alias("base"))
    won = F.sum(F.col("ones") * (F.col("b0") - F.col("base") - F.col("zeros") / 2))
    c = won / F.nullif(F.sum("ones") * F.sum("zeros"), F.lit(0.0))
    found = {r["model"]: r["c"] for r in run.join(F.broadcast(first), "model").groupBy("model").agg(F.greatest(c, 1 - c).alias("c")).collect()}
    return [found.get(i) for i in range(models)]
