"""Quantiles from stored sketches: rank error, merging, increments, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import columns, sketches
from sparkloom.streaming.sketch import sketch_stream

AT = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def frame(spark, values, parts=None):
    return spark.createDataFrame([(i, None if v is None else float(v), (parts or (lambda i: i % 7))(i)) for i, v in enumerate(values)], "id long, x double, part int")


def off(values, found, at):
    """Share of the rows by which the rank interval of each found value misses its place."""
    v = np.sort(np.array(values))
    low, high = np.searchsorted(v, found, "left") / len(v), np.searchsorted(v, found, "right") / len(v)
    return np.maximum(np.maximum(low - at, np.array(at) - high), 0).max()


@pytest.mark.parametrize("shape", ["even", "steep", "tied", "sorted"])
def test_rank_error_holds_over_merged_increments(spark, shape):
    r = np.random.default_rng(5)
    values = {"even": r.random(40_000), "steep": np.exp(6 * r.standard_normal(40_000)), "tied": np.where(r.random(40_000) < 0.4, 3.0, r.integers(0, 30, 40_000)), "sorted": np.arange(40_000.0)}[shape]
    df = frame(spark, values.tolist(), lambda i: i * 23 // 40_000)
    whole = sketches.sketch(df, ["x"], 0.01, by=["part"])
    found = sketches.quantiles(whole, ["x"], AT)["x"]
    assert off(values, found[0], AT) <= 0.01
    assert found[0][0] == values.min() and found[0][-1] == values.max()
    pairs = sketches.merge(whole.withColumn("half", F.col("part") % 2), by=["half"])
    again = sketches.quantiles(sketches.merge(pairs), ["x"], AT)["x"]
    assert off(values, again[0], AT) <= 0.01


def test_a_smaller_error_takes_a_larger_sketch():
    assert [sketches.k_for(e) for e in (0.1, 0.01, 0.001)] == sorted(sketches.k_for(e) for e in (0.1, 0.01, 0.001))
    assert all(sketches.rank_error(sketches.k_for(e)) <= e / 2 for e in (0.2, 0.05, 0.01, 0.001))
    for bad in (0.0, 1.0, -1.0, 1e-6):
        with pytest.raises(ValueError):
            sketches.k_for(bad)


def test_nulls_nans_empty_tables_and_few_values(spark):
    df = frame(spark, [None, 2.0, float("nan"), 1.0, 2.0, None, 5.0]).withColumn("y", F.lit(None).cast("double"))
    found = sketches.quantiles(sketches.sketch(df, ["x", "y"]), ["x", "y", "z"], [0.0, 1.0])
    assert found == {"x": ([1.0, 5.0], 3), "y": ([], 0), "z": ([], 0)}
    empty = sketches.sketch(df.limit(0), ["x"])
    assert empty.count() == 0 and sketches.quantiles(empty, ["x"], AT) == {"x": ([], 0)}
    assert sketches.quantiles(sketches.sketch(df, ["x"]), ["x"], []) == {"x": ([], 3)}


def test_groups_keep_their_own_quantiles(spark):
    df = spark.createDataFrame([(g, float(g * 1000 + i)) for g in (0, 1, 2) for i in range(101)], "g int, x double")
    rows = sketches.at_shares(sketches.sketch(df, ["x"], 0.01, by=["g"]), [0.0, 0.5, 1.0], by=["g"]).collect()
    got = {(r.g, r.i): r.value for r in rows}
    assert all(got[g, 0] == g * 1000 and abs(got[g, 1] - g * 1000 - 50) <= 1 and got[g, 2] == g * 1000 + 100 for g in (0, 1, 2))


def test_increments_add_up_and_a_repeated_one_replaces_itself(spark, tmp_path):
    path, r = str(tmp_path / "s"), np.random.default_rng(1)
    days = [r.normal(d, 1 + d, 3_000) for d in range(5)]
    for d, v in enumerate(days):
        sketches.add_increment(frame(spark, v.tolist()), ["x"], path, d)
    sketches.add_increment(frame(spark, days[3].tolist()), ["x"], path, 3)
    whole = sketches.stored(spark, path)
    assert whole.agg(F.sum("n")).first()[0] == 15_000
    assert off(np.concatenate(days), sketches.quantiles(whole, ["x"], AT)["x"][0], AT) <= 0.01
    late = sketches.stored(spark, path, F.col("increment") >= 3)
    assert off(np.concatenate(days[3:]), sketches.quantiles(late, ["x"], AT)["x"][0], AT) <= 0.01
    sketches.compact(spark, path, str(tmp_path / "all"))
    one = sketches.stored(spark, str(tmp_path / "all"))
    assert one.count() == 1 and one.first()["n"] == 15_000


def test_a_stream_gives_the_sketches_of_its_rows(spark, tmp_path):
    values = np.random.default_rng(2).exponential(3.0, 8_000)
    frame(spark, values.tolist()).repartition(4).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id long, x double, part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sketch_stream(rows, ["x"], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    kept = sketches.stored(spark, str(tmp_path / "out"))
    assert kept.select("increment").distinct().count() == 4 and kept.agg(F.sum("n")).first()[0] == 8_000
    assert off(values, sketches.quantiles(kept, ["x"], AT)["x"][0], AT) <= 0.01


def test_cuts_and_sets_take_stored_sketches(spark):
    values = np.random.default_rng(3).random(20_000)
    df = frame(spark, values.tolist()).withColumn("few", F.col("id") % 4)
    known = sketches.sketch(df, ["x", "few"], 0.005)
    cuts, plain = (columns.cuts_between_quantiles(df, ["x", "few"], 5, k) for k in (known, None))
    assert cuts["few"] is plain["few"] is None
    assert np.abs(np.array(cuts["x"]) - np.array(plain["x"])).max() < 0.01
    a, b = (columns.cuts_inner_quantiles(df, ["x"], 4, k)["x"] for k in (known, None))
    assert np.abs(np.array(a) - np.array(b)).max() < 0.01
    a, b = (columns.membership_table(df, ["x"], 4, k) for k in (known, None))
    assert [r[:2] for r in a] == [r[:2] for r in b] and all(abs(p - q) < 0.01 or p == q for r, s in zip(a, b) for p, q in zip(r[2:], s[2:]))
    both = columns.discretize_fuzzy(df, ["x", "few"], 4, known).select("id", F.col("x").alias("a"), F.col("few").alias("f")).join(columns.discretize_fuzzy(df, ["x", "few"], 4), "id")
    assert both.filter("a <> x").count() < 400 and both.filter("f <> few").count() == 0
