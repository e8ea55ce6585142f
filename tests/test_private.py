"""Draws of private release: secret, repeatable with the secret alone, of the right distribution."""

import hashlib
import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import private
from sparkloom.operators import release

ONE, TWO = b"one secret of 16 bytes", b"another secret of 16 b"


def test_there_is_no_default_secret():
    for f in (release.draw_release, release.k_attributes_private, release.projected_histogram, release.jitter, release.private_logistic):
        given = inspect.signature(f).parameters
        assert given["secret"].default is inspect.Parameter.empty and "seed" not in given
    for bad in (b"", b"short", "a text of more than 16", None):
        with pytest.raises(ValueError):
            private.noise_key(bad, "cells")


def test_draws_repeat_with_the_secret_alone(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"k{i}|{i % 2}") for i in range(40)], "i long, s string")
    key = private.noise_key(ONE, "x")
    got = {r.i: r for r in df.repartition(3).select("i", "s", private.keyed_digits(key, "i", "s").alias("h"), private.keyed_uniform(key, "i", "s").alias("u")).collect()}
    assert all(r.h == private.keyed_hash(key, r.i, r.s) and r.u == private.keyed_draw(key, r.i, r.s) and 0 < r.u < 1 for r in got.values())
    assert len({r.h for r in got.values()}) == 40
    other = private.noise_key(TWO, "x")
    assert not any(private.keyed_hash(other, r.i, r.s) == r.h or private.keyed_hash(private.noise_key(ONE, "y"), r.i, r.s) == r.h for r in got.values())
    assert private.keyed_hash(key, "a", "bc") != private.keyed_hash(key, "ab", "c") and private.keyed_hash(key, None) != private.keyed_hash(key, "n")


def test_public_data_cannot_repeat_the_noise(spark):
    """The released noise is none of what names, keys and guessed seeds give by the hashes at hand."""
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(200)], "id long, x double")
    noise = {s: {r.id: r.x - r.id % 4 for r in release.jitter(df, "x", 1.0, ["id"], s, 1.0).collect()} for s in (ONE, TWO)}
    assert np.corrcoef([noise[ONE][i] for i in range(200)], [noise[TWO][i] for i in range(200)])[0, 1] < 0.3
    for seed in range(50):
        for h in (hashlib.md5, hashlib.sha256):
            guess = [(int(h(f"{i}|{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 * 0.4 - 0.2 for i in range(200)]
            assert abs(np.corrcoef(guess, [noise[ONE][i] for i in range(200)])[0, 1]) < 0.4


@pytest.mark.parametrize("eps", [0.2, 1.0, 3.0])
def test_noise_is_discrete_laplace(spark, eps):
    n = 20_000
    key = private.noise_key(ONE, "cells")
    got = np.array([r[0] for r in spark.range(n).select(private.discrete_laplace(eps, key, "id")).collect()])
    a = math.exp(-eps)
    seen = np.unique(got)
    want = (1 - a) / (1 + a) * a ** np.abs(np.arange(-60, 61))
    share = np.array([(got == x).mean() for x in range(-60, 61)])
    # each share within five of its standard errors
    assert seen.dtype == np.int64 and (np.abs(share - want) < 5 * np.sqrt(want / n) + 1e-9 + 3 / n).all()
    assert abs(got.mean()) < 5 * got.std() / math.sqrt(n)


def test_chances_of_bits_multiply_to_the_geometric_distribution():
    for eps in (0.01, 0.5, 2.0):
        chance = [int(x, 16) / 16.0**private.DIGITS for x in private.laplace_bits(eps)]
        for g in range(9):
            p = math.prod(c if g >> i & 1 else 1 - c for i, c in enumerate(chance))
            assert p == pytest.approx((1 - math.exp(-eps)) * math.exp(-eps * g), rel=1e-12)
        assert 2 ** len(chance) * eps > 83


def test_histogram_reads_no_bound_and_no_value_from_the_data(spark):
    rows = [(float(i % 10), "u" if i % 2 else "v", "t" if i % 3 else "s") for i in range(900)]
    known = dict(secret=ONE, size=1000, bounds={"a": (0, 10)}, domain={"b": ["u", "v"], "t": ["s", "t", "never"]}, k=2)
    df = spark.createDataFrame(rows, "a double, b string, t string")
    hist = {(r.a, r.b, r.t): r["count"] for r in release.projected_histogram(df, ["a", "b"], "t", 4.0, **known).collect()}
    # outliers and unknown values neither move the bins nor make cells
    odd = df.union(spark.createDataFrame([(1e9, "w", "s"), (None, "u", "s"), (3.0, None, "t")], "a double, b string, t string"))
    assert {(r.a, r.b, r.t): r["count"] for r in release.projected_histogram(odd, ["a", "b"], "t", 4.0, **known).collect()} == hist
    assert all(isinstance(c, int) and a in range(5) and t in ("s", "t", "never") for (a, b, t), c in hist.items()) and abs(sum(hist.values()) - 900) < 60
    with pytest.raises(ValueError):
        release.projected_histogram(df, ["a", "b"], "t", 4.0, ONE, 1000, {"a": (0, 10)}, {"t": ["s"]})
    assert release.projected_histogram(df.limit(0), ["a", "b"], "t", 4.0, **known).filter(F.col("count") > 30).count() == 0
