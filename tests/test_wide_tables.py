"""Columns of many values: places instead of dummy columns, and swapping over 2,000 of them against numpy."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import columns, release
from test_models import draw


def test_places_follow_the_values_order_and_lead_back(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(4000) if rng.random() < 0.9 else None, rng.choice(["b", "a", None])) for i in range(9000)]
    df = spark.createDataFrame(rows, "id long, x int, y string")
    tables = {c: columns.codes(df, c) for c in ("x", "y")}
    got = {r.id: (r.x, r.y) for r in columns.coded(df, tables).collect()}
    place = {v: i for i, v in enumerate(sorted({x for _, x, _ in rows} - {None}))}
    assert got == {i: (place.get(x), {"a": 0, "b": 1}.get(y)) for i, x, y in rows}
    assert sorted(columns.decoded(columns.coded(df, tables), tables).select("id", "x", "y").collect()) == rows
    assert columns.coded(df.limit(0), {"x": columns.codes(df.limit(0), "x")}).count() == 0


def test_gramian_of_2000_dummies_equals_numpy(spark):
    rng = np.random.default_rng(4)
    rows = rng.integers(0, [1400, 500, 100], (3000, 3)) + [0, 1400, 1900]
    df = spark.createDataFrame([(x.tolist(),) for x in rows], "places array<int>")
    wide = np.zeros((3000, 2000))
    np.put_along_axis(wide, rows, 1.0, axis=1)
    assert (release.gramian(df, 2000) == wide.T @ wide).all()


def test_spectral_swap_of_many_values_matches_numpy(spark):
    """Some 120 dummies, a column of two values, nulls and a constant."""
    rng = random.Random(6)
    rows = [(i, rng.randrange(80), rng.choice("abcdefghij") if i % 9 else None, rng.choice("xy"), "k", None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, p int, q string, s string, t string, z string")
    got = {r.id: tuple(r)[1:] for r in release.spectral_swap(df, ["p", "q", "s", "t", "z"], "id").collect()}
    ps, qs = sorted({r[1] for r in rows}), "abcdefghij"
    wide = np.array([[*(float(r[1] == v) for v in ps), *(float(r[2] == v) for v in qs), float(r[3] == "y"), 0.0, 0.0] for r in rows])
    values, v = np.linalg.eigh(wide.T @ wide)
    v = v[:, values > values.max() * 1e-10]
    scores, target = wide @ v, {i: n for n, i in enumerate(sorted(range(400), key=lambda i: draw(i)))}
    swapped = np.empty_like(scores)
    for j in range(v.shape[1]):
        source = sorted(range(400), key=lambda i: draw(i, j, seed=1))
        swapped[:, j] = [scores[source[target[i]], j] for i in range(400)]
    back = swapped @ v.T
    m, clear = len(ps), 0
    for i, b in enumerate(back):
        assert got[i][3:] == ("k", None)
        gaps = np.diff(np.sort(b[:m]))[-1], np.diff(np.sort(b[m : m + 10]))[-1], abs(b[m + 10] - 0.5)
        if min(gaps) > 1e-9:
            clear += 1
            assert got[i][:3] == (ps[int(b[:m].argmax())], qs[int(b[m : m + 10].argmax())], "xy"[int(b[m + 10] > 0.5)])
    assert clear > 300


def test_spectral_swap_of_2000_values_in_bounded_batches(spark):
    df = spark.range(2100).select("id", (F.col("id") % 1950).alias("p"), (F.col("id") % 50).cast("string").alias("q"))
    out = release.spectral_swap(df.filter("id < 300").unionByName(df.filter("id >= 1900")), ["p", "q"], "id")
    assert out.count() == 500 and out.filter("p is null or q is null").count() == 0
    assert release.spectral_swap(df.limit(0), ["p", "q"], "id").count() == 0
