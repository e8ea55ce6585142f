"""Maps of values by frequency against an assignment of all pairs, and recovery beside a column of many values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import matching
from sparkloom.operators.transport import used_capacity


@pytest.mark.parametrize("seed", range(0, 400, 40))
def test_transport_is_the_best_of_all_assignments(seed):
    for s in range(seed, seed + 40):
        rng = random.Random(s)
        places = [(p, rng.randrange(4), rng.randrange(6)) for p in sorted(rng.sample(range(40), rng.randrange(1, 9)))]
        units = [p for p, n, _ in places for _ in range(n)]
        room = [p for p, _, n in places for _ in range(n)]
        if not units or len(units) > len(room):
            continue
        used = used_capacity(places)
        assert sum(used) == len(units) and all(0 <= u <= c for u, (_, _, c) in zip(used, places))
        cost = np.abs(np.subtract.outer(units, room)).astype(float)
        taken = [p for u, (p, _, _) in zip(used, places) for _ in range(u)]
        assert sum(abs(x - y) for x, y in zip(units, taken)) == cost[np.arange(len(units)), matching.assignment(cost)].sum()


def rows_of(rng, names, spread):
    return [(x,) for name in names for x in [name] * int(spread * rng.random() ** 3 + 1)]


@pytest.mark.parametrize("sizes", [(500, 500), (500, 430), (120, 300), (1, 7)])
def test_frequency_map_is_as_good_as_the_assignment_of_all_pairs(spark, sizes):
    rng = random.Random(sum(sizes))
    v = rows_of(rng, [f"a{i}" for i in range(sizes[0])], 40) + [(None,)] * 9
    w = rows_of(rng, [f"b{i}" for i in range(sizes[1])], 60)
    got = matching.frequency_map(spark.createDataFrame(v, "x string"), spark.createDataFrame(w, "x string"), ["x"]).collect()
    share = lambda rows: {r: sum(1 for (x,) in rows if x == r) / sum(x is not None for (x,) in rows) for r in {x for (x,) in rows} - {None}}
    fa, fb = share(v), share(w)
    assert len({r.a for r in got}) == len({r.b for r in got}) == len(got) == min(sizes)
    few, many = sorted((list(fa.values()), list(fb.values())), key=len)
    cost = np.abs(np.subtract.outer(few, many))
    want = cost[np.arange(len(few)), matching.assignment(cost)].sum()
    assert sum(abs(fa[r.a] - fb[r.b]) for r in got) == pytest.approx(want, abs=1e-9)


def test_frequency_map_of_many_values(spark):
    """100,000 values, most of them once: every one has a partner, and no pairs are made."""
    v = spark.range(150_000).select(F.when(F.col("id") < 100_000, F.col("id")).otherwise(F.pmod(F.hash("id"), F.lit(300))).cast("string").alias("x"))
    w = v.select(F.concat(F.lit("w"), "x").alias("x")).unionByName(spark.range(7).select(F.concat(F.lit("new"), "id").alias("x")))
    got = matching.frequency_map(v, w, ["x"])
    assert got.agg(F.count("*"), F.countDistinct("a"), F.countDistinct("b")).first() == (100_000, 100_000, 100_000)


def test_frequency_map_of_nothing(spark):
    some, none = spark.createDataFrame([("p", None), ("q", None)], "x string, y string"), spark.createDataFrame([], "x string, y string")
    for v, w in ((some, none), (none, some), (none, none)):
        assert matching.frequency_map(v, w, ["x", "y"]).count() == 0
    assert [tuple(r) for r in matching.frequency_map(some, some, ["x", "y"]).orderBy("a").collect()] == [("x", "p", "p"), ("x", "q", "q")]


def test_recovery_beside_a_column_of_many_values(spark, monkeypatch):
    """Beyond VALUES a column keeps its map by frequency, and the others are recovered as before."""
    monkeypatch.setattr(matching, "VALUES", 20)
    rng = random.Random(3)
    wide = [f"k{i}" for i in range(30) for _ in range(i + 1)]
    rows = [(i, k, "st"[int(k[1:]) % 2 if rng.random() < 0.95 else rng.randrange(2)], rng.choice("mmmn")) for i, k in enumerate(wide)]
    w = spark.createDataFrame(rows, "id long, k string, s string, m string")
    v = w.select("id", *(F.concat(F.lit("v_"), c).alias(c) for c in ("k", "s", "m")))
    found = matching.recover_values(v, w, ["k", "s", "m"], "id")
    assert found.count() == 34 and found.filter(F.col("a") != F.concat(F.lit("v_"), F.col("b"))).count() == 0
    assert matching.recover_values(v, w, ["k"], "id").count() == 30
