"""Near copies among vectors against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import vector_dedup as vd


def plain(rows, least=0.93):
    """rows: (id, label, vector or None)."""
    n = len(rows)
    ok = [x is not None and y is not None and len(y) and all(c is not None and math.isfinite(c) for c in y) and any(y) for _, x, y in rows]
    group = list(range(n))
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                a, b = (np.array(rows[k][2], np.float64) for k in (i, j))
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
    out = []
    for i in range(n):
        least_id = min((rows[j][0] for j in range(n) if group[j] == group[i] and rows[j][0] is not None), default=None)
        out.append((rows[i][0], links[i], least_id, rows[i][0] == least_id))
    return out


def given(n=260, d=10, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, d))
    v = centre[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * rng.choice([0.1, 0.3, 0.5], (n, 1))
    v[40:70] = v[3]
    rows = [(i, int(x), y.tolist()) for i, x, y in zip(range(n), rng.integers(0, 2, n), v)]
    rows += [(300, None, v[0].tolist()), (301, 1, None), (302, 1, [0.0] * d), (303, 0, [float("nan")] * d), (304, 0, [None] * d), (305, 0, [1.0, 2.0]), (306, 0, [2.0, 4.0]), (307, 1, []), (None, 0, v[3].tolist()), (None, 0, [-5.0] * 4), (5, 0, v[5].tolist()), (5, 0, v[5].tolist())]
    return rows


def key(rows):
    return sorted((tuple(x) for x in rows), key=str)


@pytest.mark.parametrize(("part", "chunk"), [(4096, 1024), (40, 16), (7, 5)])
def test_near_vectors_match_brute_force(spark, monkeypatch, part, chunk):
    monkeypatch.setattr(vd, "PART", part)
    monkeypatch.setattr(vd, "CHUNK", chunk)
    df = spark.createDataFrame(given(), "vec_id long, label int, embedding array<double>").withColumns({"v": F.lit("clash"), "node": F.lit(1), "cell": F.lit(1), "weight": F.lit(2)})
    assert key(vd.near_vectors(df).collect()) == key(plain(given()))
    assert vd.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_any_size(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 8))
    rows = [(i, 1, (base[i % 20] * 10.0 ** float(e) + 0).tolist()) for i, e in enumerate(rng.integers(-250, 250, 80))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert key(vd.near_vectors(df).collect()) == key(plain(rows))


def test_many_copies_make_one_class(spark):
    df = spark.range(20_000).select(F.col("id").alias("vec_id"), F.lit(4).alias("label"), F.array(F.lit(1.0), (F.col("id") % 3 / 100).cast("double")).alias("embedding"))
    got = vd.near_vectors(df).groupBy("n_links", "component_id", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(19_999, 0, False, 19_999), (19_999, 0, True, 1)]


def test_codes_estimate_without_bias_and_bounds_hold():
    rng = np.random.default_rng(6)
    d, least = 64, 0.93
    x = rng.normal(size=(400, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.normal(size=x.shape) * 0.045
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = (x * y).sum(1)
    off = []
    for seed in range(20):
        turn = vd.rotation(d, seed)
        assert np.allclose(turn @ turn.T, np.eye(d))
        codes, factor = vd.encode(x, turn)
        signs = (np.unpackbits(codes, axis=1, count=d) * 2.0 - 1) / math.sqrt(d)
        a = (signs * (y @ turn)).sum(1)
        off.append(a / factor - cos)
        near = cos >= least
        assert near.any() and (a[near] >= vd.least_products(factor, d, least)[near]).all()
        # what is far apart is mostly excluded without a look at the vectors
        assert np.mean(signs @ (y @ turn).T >= vd.least_products(factor, d, least)[:, None]) < 0.01
    assert abs(np.mean(off)) < 0.002


def test_few_pairs_are_computed_again():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(1500, 64))
    codes = vd.encode(v / np.linalg.norm(v, axis=1, keepdims=True), vd.rotation(64))
    part = vd.Part(np.arange(1500), np.ones(1500, np.int64), v, *codes, 0.93)
    part.meet_itself()
    assert part.exact < 0.001 * 1500 * 1500 and part.count.sum() == 0
