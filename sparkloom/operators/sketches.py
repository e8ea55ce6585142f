"""Quantiles from stored sketches: a table of sketches for each increment of the data, merged when asked.

An increment is read once, when it arrives.  Quantiles of everything that came so far read the sketches
alone: a few kilobytes for each column and group, whatever the number of rows behind them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.helpers import materialize

#: parameter of the sketches for values: KLL accepts 8 to 65,535
SMALLEST_K, LARGEST_K = 8, 65_535
#: different values up to which their number is exact (2 ** LG_VALUES), an estimate beyond
LG_VALUES = 12


def rank_error(k: int) -> float:
    """Share of the rows by which one quantile's rank is off at most, in 99 of 100 sketches of parameter k (published fit)."""
    return 2.296 / k**0.9021


def k_for(error: float) -> int:
    """A parameter at which a rank is off by more than ``error`` only beyond five standard deviations.

    The published error covers 2.6 standard deviations, so half of ``error`` is asked of it.
    """
    k = math.ceil((2.296 / (error / 2)) ** (1 / 0.9021)) if 0 < error < 1 else 0
    if not 0 < k <= LARGEST_K:
        raise ValueError(f"no sketch has a rank error of {error}")
    return max(k, SMALLEST_K)


def sketch(df: DataFrame, cols: list[str], error: float = 0.01, by: list[str] | None = None) -> DataFrame:
    """by.., col, n, low, high, quantiles, kinds: a row for each column and group; one aggregate with map-side combining.

    Nulls and NaNs are left out; a group without values has no row, nor has an empty table.  low and high are exact.
    """
    by = by or []
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value")) for c in cols)))
    rows = df.select(*by, cells.alias("x")).select(*by, "x.*").filter(~F.isnan("value") & F.col("value").isNotNull())
    k = F.lit(k_for(error))
    return rows.groupBy(*by, "col").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.kll_sketch_agg_double("value", k).alias("quantiles"), F.theta_sketch_agg("value", F.lit(LG_VALUES)).alias("kinds"),
    )


def merge(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of any number of increments or groups as one for each column and value of by: same columns as sketch.

    Merging is associative and doesn't add to the rank error; merging what was merged gives what one step gives, up to
    that error.  Sketches of different parameters have the error of the worse.
    """
    return sketches.groupBy(*(by or []), "col").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.theta_union_agg("kinds", F.lit(LG_VALUES)).alias("kinds"),
    )


def add_increment(df: DataFrame, cols: list[str], path: str, increment: str | int, error: float = 0.01, by: list[str] | None = None) -> None:
    """Store the sketches of an increment under its own name in path, a folder shared by the cluster.

    An increment written again replaces its earlier sketches, so a repeated load doesn't count twice.
    """
    sketch(df, cols, error, by).write.mode("overwrite").parquet(f"{path}/increment={increment}")


def stored(spark: SparkSession, path: str, increments: Column | None = None) -> DataFrame:
    """The sketches in path, with their increment; increments: a condition on it, which prunes the folders that are read."""
    found = spark.read.parquet(path)
    return found.filter(increments) if increments is not None else found


def compact(spark: SparkSession, path: str, target: str, by: list[str] | None = None) -> None:
    """All increments of path merged into one increment, ``all``, of the folder target."""
    merge(stored(spark, path), by).write.mode("overwrite").parquet(f"{target}/increment=all")


def at_shares(sketches: DataFrame, at: list[float], by: list[str] | None = None) -> DataFrame:
    """by.., col, i, share, value, n: the quantile at each share (i from 0); the smallest and largest value are exact.

    Values are values of the column, not interpolated; each one's rank is within the sketches' rank error of share * n.
    """
    def value(p: float) -> Column:
        return F.col("low") if p <= 0 else F.col("high") if p >= 1 else F.kll_sketch_get_quantile_double("quantiles", F.lit(p))

    found = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("share"), value(float(p)).alias("value")) for i, p in enumerate(at))))
    return materialize(merge(sketches, by)).select(*(by or []), "col", "n", found.alias("x")).select(*(by or []), "col", "x.*", "n")


def quantiles(sketches: DataFrame, cols: list[str], at: list[float]) -> dict[str, tuple[list[float], int]]:
    """What columns.quantiles gives, from sketches: quantiles of each column and its number of different values.

    That number is exact up to 2 ** LG_VALUES. A column without values has none.
    """
    whole = materialize(merge(sketches))
    kinds = {r["col"]: r["kinds"] for r in whole.select("col", F.theta_sketch_estimate("kinds").alias("kinds")).collect()}
    found: dict[str, dict[int, float]] = {}
    for r in at_shares(whole, at).collect() if at else []:
        found.setdefault(r["col"], {})[r["i"]] = r["value"]
    return {c: ([found[c][i] for i in range(len(at))] if at else [], kinds[c]) if c in kinds else ([], 0) for c in cols}
