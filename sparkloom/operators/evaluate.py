"""Scores of predictions, paired tests, cross-validation and variable selection."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.distributions import norm_cdf
from sparkloom.operators import logistic
from sparkloom.operators.helpers import global_cumsum, materialize, uniform


def cindex(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """One row: cindex, se, seb, z, m, sd. actual is 0 or 1; ties count half; null without both classes.

    One group by score, running counts in score order, one aggregate.  se is Hanley and McNeil's from
    the pair sums Q1 and Q2, seb the conservative bound sqrt(c (1 - c) / min(n0, n1)); an index under
    one half is turned over at the end.
    """
    g = df.filter(F.col(pred).isNotNull() & F.col(actual).isNotNull()).groupBy(F.col(pred).cast("double").alias("p")).agg(F.sum(F.col(actual).cast("double")).alias("ones"), F.sum(1 - F.col(actual).cast("double")).alias("zeros"))
    run = global_cumsum(g, [F.col("p").asc()], {"b1": F.col("ones"), "b0": F.col("zeros")})
    total = run.agg(F.sum("ones").alias("n1"), F.sum("zeros").alias("n0")).first()
    n1, n0 = total["n1"] or 0.0, total["n0"] or 0.0
    if not n1 or not n0:
        return df.sparkSession.createDataFrame([(None,) * 6], "cindex double, se double, seb double, z double, m double, sd double")
    below0, above1 = F.col("b0") - F.col("zeros"), n1 - F.col("b1")
    sums = run.agg(
        F.sum(F.col("ones") * (below0 + F.col("zeros") / 2)).alias("won"),
        F.sum(F.col("zeros") * (above1 * above1 + above1 * F.col("ones") + F.col("ones") * F.col("ones") / 3)).alias("q1"),
        F.sum(F.col("ones") * (below0 * below0 + below0 * F.col("zeros") + F.col("zeros") * F.col("zeros") / 3)).alias("q2"),
    )
    c = F.col("won") / (n0 * n1)
    q1, q2 = F.col("q1") / (n0 * n1 * n1), F.col("q2") / (n1 * n0 * n0)
    se = F.sqrt(F.greatest((c * (1 - c) + (n1 - 1) * (q1 - c * c) + (n0 - 1) * (q2 - c * c)) / (n0 * n1), F.lit(0.0)))
    seb = F.sqrt(c * (1 - c) / min(n0, n1))
    sd = math.sqrt((n0 + n1 + 1) / (12 * n0 * n1))
    out = sums.select(c.alias("c"), se.alias("se"), seb.alias("seb"))
    z = F.abs(F.col("c") - 0.5) / sd
    return out.select(F.greatest(F.col("c"), 1 - F.col("c")).alias("cindex"), "se", "seb", z.alias("z"), F.lit(0.5).alias("m"), F.lit(sd).alias("sd"))


#: the grid of the published table: average correlations and average areas
HANLEY_CORR, HANLEY_AREA = (0.02, 0.90, 45), (0.700, 0.975, 12)


@lru_cache(1)
def hanley_grid() -> np.ndarray:
    """The published correlations of two areas, from the rule behind them, to two decimals.

    Both scores are normal in each class, rho apart in correlation and sqrt(2) probit(area) apart in mean;
    the areas' correlation is that of the normal scores Phi(x1), Phi(x2) of the case class.  Agrees
    with the printed table within 0.02; pass the printed one to hanley_r to have it to the digit.
    """
    x, w = np.polynomial.hermite_e.hermegauss(48)
    w = w / w.sum()
    out = np.zeros((HANLEY_CORR[2], HANLEY_AREA[2]))
    for j, area in enumerate(np.linspace(*HANLEY_AREA)):
        mean = math.sqrt(2) * NormalDist().inv_cdf(area)
        f = norm_cdf(mean + x)
        m = w @ f
        for i, rho in enumerate(np.linspace(*HANLEY_CORR)):
            other = norm_cdf(mean + rho * x[:, None] + math.sqrt(1 - rho * rho) * x) @ w
            out[i, j] = round(((w * f) @ other - m * m) / (w @ (f * f) - m * m), 2)
    return out


def hanley_r(corr: float, area: float, grid: np.ndarray | None = None) -> float | None:
    """Correlation between two areas under the curve, bilinear in the grid; None outside of it."""
    grid = hanley_grid() if grid is None else grid
    (c0, c1, nc), (a0, a1, na) = HANLEY_CORR, HANLEY_AREA
    if not (c0 <= corr <= c1 and a0 <= area <= a1):
        return None
    u, v = (corr - c0) / (c1 - c0) * (nc - 1), (area - a0) / (a1 - a0) * (na - 1)
    i, j = min(int(u), nc - 2), min(int(v), na - 2)
    u, v = u - i, v - j
    return float((1 - u) * (1 - v) * grid[i, j] + u * (1 - v) * grid[i + 1, j] + (1 - u) * v * grid[i, j + 1] + u * v * grid[i + 1, j + 1])


def average_ranks(df: DataFrame, col: str, by: str, out: str) -> DataFrame:
    """df with out: rank of col within by, tied rows sharing the mean of their ranks.

    Values are counted and put in order by range partitions with running counts, then met by rows in an equi-join.
    """
    n = df.groupBy(F.col(by).alias("__by"), F.col(col).alias("__v")).agg(F.count("*").alias("__n"))
    run = materialize(global_cumsum(n, [F.col("__by"), F.col("__v")], {"__to": F.col("__n")}))
    first = run.groupBy(F.col("__by").alias("__of")).agg(F.min(F.col("__to") - F.col("__n")).alias("__base"))
    rank = F.col("__to") - F.col("__base") - (F.col("__n") - 1) / 2
    ranks = run.join(first, F.col("__by").eqNullSafe(F.col("__of"))).select("__by", "__v", rank.alias(out))
    return df.join(ranks, F.col(by).eqNullSafe(F.col("__by")) & F.col(col).eqNullSafe(F.col("__v"))).drop("__by", "__v")


def hanley_test(df: DataFrame, pred1: str, pred2: str, actual: str, ctype: str = "pearson", p_value: Callable[[Column], Column] | None = None, grid: np.ndarray | None = None) -> DataFrame:
    """z (and p) of the difference of two c-indexes on the same rows; null where no correlation is tabled.

    grid: the table of correlations, HANLEY_CORR x HANLEY_AREA; without, that of hanley_grid().
    """
    a, b = cindex(df, pred1, actual).first(), cindex(df, pred2, actual).first()
    rows, c1, c2 = df, pred1, pred2
    if ctype == "spearman":
        rows = average_ranks(average_ranks(df, pred1, actual, "__r1"), pred2, actual, "__r2")
        c1, c2 = "__r1", "__r2"
    corr = rows.groupBy(actual).agg(F.corr(c1, c2).alias("r")).agg(F.avg("r")).first()[0]
    r = hanley_r(corr, (a["cindex"] + b["cindex"]) / 2, grid) if corr is not None and a["cindex"] is not None else None
    z = None if r is None else (a["cindex"] - b["cindex"]) / math.sqrt(max(a["se"] ** 2 + b["se"] ** 2 - 2 * r * a["se"] * b["se"], 1e-300))
    out = df.sparkSession.createDataFrame([(a["cindex"], b["cindex"], corr, r, z)], "c1 double, c2 double, corr double, r double, z double")
    return out.withColumn("p", p_value(F.col("z"))) if p_value else out


def mcnemar(df: DataFrame, correct1: str, correct2: str) -> DataFrame:
    """rw, wr (right by one only), z with continuity correction; null z where both are 0."""
    c1, c2 = F.col(correct1), F.col(correct2)
    n = df.agg(F.count_if(c1 & ~c2).alias("rw"), F.count_if(~c1 & c2).alias("wr"))
    return n.withColumn("z", F.when(F.col("rw") + F.col("wr") > 0, (F.abs(F.col("rw") - F.col("wr")) - 1) / F.sqrt(F.col("rw") + F.col("wr"))))


def accuracy(df: DataFrame, pred: str, label: str) -> DataFrame:
    return df.agg(F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"))


def logistic_scores(train: DataFrame, test: DataFrame, features: list[str], label: str, reg: float = 0.0) -> DataFrame:
    """test with column score: probability of label 1 by logistic regression."""
    whole = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip")
    model = LogisticRegression(featuresCol="__x", labelCol=label, regParam=reg, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y").fit(whole.transform(train))
    return model.transform(whole.transform(test)).withColumn("score", vector_to_array("__p")[1]).drop("__x", "__p", "__r", "__y")


def logistic_cindex(train: DataFrame, test: DataFrame, features: list[str], label: str) -> float | None:
    """c-index on test of the logistic regression fitted to train, by Newton steps to the best likelihood; None without both classes."""
    fits = logistic.fit(materialize(logistic.prepared(train, features, label)), [logistic.Model((1,) * len(features))])
    return logistic.held_cindexes(logistic.prepared(test, features, label), fits)[0]


def subset_scores(masks: list[tuple[int, ...]], train: DataFrame, hold: DataFrame, rho: float = 0.5) -> list[float]:
    """rho * c-index on hold + (1 - rho) * fraction of unused features for each mask; 0 for the empty one.

    train and hold are prepared rows (logistic.prepared); all masks are fitted and scored together.
    """
    models = [logistic.Model(m) for m in masks if any(m)]
    found = logistic.held_cindexes(hold, logistic.fit(train, models)) if models else []
    value = {m.mask: rho * (c or 0.0) + (1 - rho) * (1 - sum(m.mask) / len(m.mask)) for m, c in zip(models, found)}
    return [value.get(m, 0.0) for m in masks]


def select_variables(train: DataFrame, hold: DataFrame, test: DataFrame, features: list[str], label: str, rho: float = 0.5, size: int = 8, generations: int = 3, elite: int = 2, flip: float = 0.2, seed: int = 0) -> dict:
    """Genetic search over feature masks; a generation's new masks are fitted together, known masks are looked up."""
    rng = random.Random(seed)
    known: dict[tuple[int, ...], float] = {}
    people = [tuple(rng.randint(0, 1) for _ in features) for _ in range(size)]
    part = [materialize(logistic.prepared(x, features, label)) for x in (train, hold, test)]

    def rate(masks: list[tuple[int, ...]]) -> None:
        if new := sorted(set(masks) - known.keys()):
            known.update(zip(new, subset_scores(new, part[0], part[1], rho)))

    for _ in range(generations):
        rate(people)
        best = sorted(set(people), key=lambda m: (-known[m], m))
        nxt = best[:elite]
        weights = [known[m] + 1e-9 for m in people]
        while len(nxt) < size:
            a, b = rng.choices(people, weights, k=2)
            cut = rng.randrange(1, len(features)) if len(features) > 1 else 0
            nxt.append(tuple(1 - x if rng.random() < flip else x for x in a[:cut] + b[cut:]))
        people = nxt
    rate(people)
    mask = max(known, key=lambda m: (known[m], m))
    fits = logistic.fit(part[0], [logistic.Model(mask)])
    ends = [logistic.held_cindexes(x, fits)[0] for x in (part[0], part[2])]
    return {"variables": [f for f, m in zip(features, mask) if m], "train": ends[0], "test": ends[1], "score": known[mask]}


def folds(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """df with fold 0..n-1 by a seeded hash of its key."""
    return df.withColumn("fold", F.floor(uniform(*key, seed=seed) * n).cast("int"))


def cross_validate(df: DataFrame, models: dict[str, Callable[[DataFrame, DataFrame], DataFrame]], score: Callable[[DataFrame], float | None], n: int, key: list[str], reps: int = 1, seed: int = 0) -> DataFrame:
    """rep, fold, model, score: all models on the same folds. cv52 is n=2, reps=5."""
    out = []
    for rep in range(reps):
        dealt = folds(df, n, key, seed + rep)
        for k in range(n):
            train, test = dealt.filter(F.col("fold") != k).drop("fold"), dealt.filter(F.col("fold") == k).drop("fold")
            out += [(rep, k, name, score(f(train, test))) for name, f in models.items()]
    return df.sparkSession.createDataFrame(out, "rep int, fold int, model string, score double")


def cross_validate_logistic(df: DataFrame, models: dict[str, list[str]], label: str, n: int, key: list[str], reps: int = 1, seed: int = 0) -> DataFrame:
    """rep, fold, model, score: c-indexes of logistic regressions, each on some features, on the folds of cross_validate.

    The fits of all models, folds and repetitions share every pass over the table, so jobs grow with Newton steps alone.
    """
    features = sorted({c for cols in models.values() for c in cols})
    dealt = df.withColumn("__folds", F.array(*(F.floor(uniform(*key, seed=seed + rep) * n).cast("int") for rep in range(reps))))
    rows = materialize(logistic.prepared(dealt, features, label, "__folds"))
    asked = [(rep, k, name) for rep in range(reps) for k in range(n) for name in models]
    each = [logistic.Model(tuple(int(c in models[name]) for c in features), rep, k) for rep, k, name in asked]
    found = logistic.held_cindexes(rows, logistic.fit(rows, each))
    return df.sparkSession.createDataFrame([(*a, c) for a, c in zip(asked, found)], "rep int, fold int, model string, score double")
