"""Greedy covers and samples against plain Python, with a bound on the number of counts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import assoc, discern


def cover(sets, tau=1.0, cost=None):
    left, out = {k: set(v) for k, v in sets.items()}, []
    goal = tau * len(set().union(*sets.values()))
    gone = 0
    while gone < goal:
        value = lambda k: len(left[k]) / (cost[k] if cost else 1.0)
        best = max(left, key=lambda k: (value(k), k if cost else -k))
        if not left[best]:
            break
        out.append(best)
        gone += len(left[best])
        new = set(left[best])
        left = {k: v - new for k, v in left.items()}
    return out


def union(sets, k):
    out, have = [], set()
    while len(out) < k <= len(sets):
        best = min((x for x in sets if x not in out), key=lambda x: (len(sets[x] - have), x))
        out.append(best)
        have |= sets[best]
    return out


def given(seed, n, elements, most):
    rng = random.Random(seed)
    return {i: {rng.randrange(elements) for _ in range(rng.randrange(1, most))} for i in range(n)}


def frame(spark, sets):
    return spark.createDataFrame([(k, e) for k, v in sets.items() for e in sorted(v)] * 2, "set_id long, element long").repartition(3)


@pytest.mark.parametrize(("n", "elements", "most", "tau"), [(200, 2000, 40, 1.0), (60, 150, 30, 0.9), (40, 30, 4, 1.0), (10, 40, 9, 1.0)])
def test_cover_takes_the_picks_of_brute_force(spark, monkeypatch, n, elements, most, tau):
    sets = given(n, n, elements, most)
    written, real = [], discern.materialize
    monkeypatch.setattr(discern, "materialize", lambda df: written.append(1) or real(df))
    got = discern.greedy_cover(frame(spark, sets), tau)
    assert got == cover(sets, tau)
    # counts of all sets, and the table at the start: a fourth of the picks where many sets compete, fewer than half on small ones
    assert len(written) <= max(2, len(got) // (4 if n == 200 else 2) + 1)
    cost = {k: 1.0 + k % 3 for k in sets}
    assert discern.greedy_cover(frame(spark, sets), tau, cost) == cover(sets, tau, cost)


@pytest.mark.parametrize(("n", "elements", "most", "k"), [(60, 25, 5, 20), (50, 300, 12, 7), (8, 20, 5, 8), (5, 9, 3, 6)])
def test_union_takes_the_picks_of_brute_force(spark, n, elements, most, k):
    sets = given(n + 1, n, elements, most)
    assert discern.min_union(frame(spark, sets), k) == union(sets, k)


def test_samples_are_the_rows_with_the_smallest_hashes(spark, monkeypatch):
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("x")).repartition(3)
    ranked = []

    def measure(samples, by):
        ranked.append(samples)
        return samples.groupBy("rep").agg(F.sum("x").alias("x"), F.count("*").alias("n")).withColumn("g", F.lit(1))

    out = assoc.repeated(df, measure, 30, 20, ["id"], ["g"], seed=4).first()
    u = lambda i, r: int(hashlib.md5(f"{i}|{r}|4".encode()).hexdigest()[:13], 16)
    want = {r: {i for _, i in sorted((u(i, r), i) for i in range(400))[:20]} for r in range(1, 31)}
    got = {}
    for r in ranked[0].collect():
        got.setdefault(r.rep, set()).add(r.id)
    assert got == want and out.n == 20
    few = assoc.repeated(df.filter("id < 6"), measure, 5, 20, ["id"], ["g"])
    assert few.first().n == 6
