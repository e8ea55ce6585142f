"""Logistic regressions fitted together: against one by one in numpy, on given rows too, and the number of jobs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import evaluate, logistic
from test_models import draw


def newton(x, y):
    """Plain weights of one regression, the intercept first."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.pinv((x * (p * (1 - p))[:, None]).T @ x) @ (x.T @ (y - p))
    return w


def cindex(score, y):
    a, b = score[y == 1], score[y == 0]
    c = ((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2) / (len(a) * len(b))
    return max(c, 1 - c)


def points(n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(0, 1, n), rng.normal(5e4, 9e3, n), rng.integers(0, 3, n)]).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] - 5e4) / 9e3 - 0.5)))).astype(float)
    return x, y


def test_all_masks_and_folds_equal_single_fits(spark):
    x, y = points()
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")
    folds = np.array([math.floor(draw(i) * 3) for i in range(len(y))])
    dealt = df.withColumn("f", F.array(F.floor(evaluate.uniform("id") * 3).cast("int")))
    rows = logistic.prepared(dealt, ["a", "b", "c"], "y", "f").repartition(5)
    models = [logistic.Model(m, 0, k) for m in itertools.product((0, 1), repeat=3) if any(m) for k in range(3)]
    fits = logistic.fit(rows, models)
    got = logistic.cindexes(logistic.scored(rows, fits), len(models))
    for m, w, c in zip(models, fits.weights, got):
        used = np.flatnonzero(m.mask)
        want = newton((x[:, used] - fits.center[used])[folds != m.fold] / fits.scale[used], y[folds != m.fold])
        assert w == pytest.approx(want, abs=1e-5)
        held = folds == m.fold
        z = np.column_stack([np.ones(held.sum()), (x[held][:, used] - fits.center[used]) / fits.scale[used]]) @ want
        assert c == pytest.approx(cindex(z, y[held]), abs=1e-6)
    table = evaluate.cross_validate_logistic(df, {"all": ["a", "b", "c"], "a": ["a"]}, "y", 3, ["id"])
    by = {(r.fold, r.model): r.score for r in table.collect()}
    for m, c in zip(models, got):
        if m.mask in ((1, 1, 1), (1, 0, 0)):
            assert by[m.fold, "all" if sum(m.mask) == 3 else "a"] == pytest.approx(c, abs=1e-9)


def test_agrees_with_the_library_model(spark):
    x, y = points(600, 4)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    rows = logistic.prepared(df, ["a", "b", "c"], "y")
    got = logistic.cindexes(logistic.scored(rows, logistic.fit(rows, [logistic.Model((1, 1, 1))])), 1)[0]
    assert got == pytest.approx(evaluate.logistic_cindex(df, df, ["a", "b", "c"], "y"), abs=1e-4)


def test_missing_constant_separated_and_empty(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        a = rng.gauss(0, 1)
        rows.append((a, [None, float("nan"), rng.gauss(0, 1)][min(i % 5, 2)], 7.0, float(a > 0) if i % 50 else None))
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    ready = logistic.prepared(df, ["a", "b", "c"], "y")
    masks = [(1, 0, 0), (1, 1, 0), (0, 0, 1), (1, 0, 1)]
    fits = logistic.fit(ready, [logistic.Model(m) for m in masks])
    assert all(np.isfinite(w).all() for w in fits.weights)
    assert logistic.cindexes(logistic.scored(ready, fits), 4) == pytest.approx([1.0, 1.0, 0.5, 1.0])
    known = sum(b is not None and b == b and y is not None for _, b, _, y in rows)
    assert logistic.scored(ready, fits).filter("model = 1").count() == known
    none = ready.limit(0)
    assert logistic.cindexes(logistic.scored(none, logistic.fit(none, [logistic.Model((1, 1, 1))])), 1) == [None]
    one = logistic.prepared(df.filter("y = 1"), ["a", "b", "c"], "y")
    assert logistic.cindexes(logistic.scored(one, logistic.fit(one, [logistic.Model((1, 0, 0))])), 1) == [None]


def test_jobs_do_not_grow_with_models(spark):
    x, y = points(300, 2)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    rows = logistic.prepared(df, ["a", "b", "c"], "y")

    def jobs(models, group):
        spark.sparkContext.setJobGroup(group, group)
        logistic.fit(rows, models)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    masks = [logistic.Model(m) for m in itertools.product((0, 1), repeat=3) if any(m)]
    assert jobs(masks, "many") <= jobs([logistic.Model((1, 1, 1))], "one") + 4
    spark.sparkContext.setJobGroup("", "")
