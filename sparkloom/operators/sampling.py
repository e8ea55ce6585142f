"""Weighted samples, order, and scores of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.helpers import global_cumsum, materialize, uniform

#: distance that means "no connection"
BARRIER = 1_000_000.0
FORBIDDEN = 1e-12


def weighted_with_replacement(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """draw (0..n-1), key: each draw takes a row with chance weight / total.

    Draws and rows meet on equal slices of the running weight, so the range join is an equi-join.
    """
    run = materialize(global_cumsum(df.filter(F.col(weight) > 0).select(key, weight), [F.col(key)], {"hi": F.col(weight).cast("double")}))
    total = run.agg(F.max("hi")).first()[0]
    if not total:
        return run.select(F.lit(0).alias("draw"), key).limit(0)
    slices = max(1, n)
    width = total / slices
    spans = run.withColumn("lo", F.col("hi") - F.col(weight)).withColumn("slice", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (uniform("id", seed=seed) * total).alias("u")).withColumn("slice", F.floor(F.col("u") / width))
    return draws.join(spans, "slice").filter((F.col("u") > F.col("lo")) & (F.col("u") <= F.col("hi"))).select("draw", key)


def weighted_without_replacement(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by exponential keys: the smallest -log(u) / weight."""
    return df.filter(F.col(weight) > 0).orderBy(-F.log(uniform(key, seed=seed)) / F.col(weight), key).limit(n)


def systematic(df: DataFrame, key: str, weight: str, n: int, start: float = 0.5) -> DataFrame:
    """key, copies: how many of the n evenly spaced points fall in each row's stretch, heaviest rows first."""
    run = materialize(global_cumsum(df.select(key, F.col(weight).cast("double").alias("w")), [F.desc("w"), F.asc(key)], {"hi": F.col("w")}))
    step = (run.agg(F.max("hi")).first()[0] or 0.0) / n
    count = lambda x: F.ceil(x / step - start)  # noqa: E731  points start * step, (start + 1) * step, .. below x
    return run.withColumn("copies", (count(F.col("hi")) - count(F.col("hi") - F.col("w"))).cast("long")).select(key, "copies")


def top_k(df: DataFrame, score: Column, k: int, ties: list[str]) -> DataFrame:
    return df.orderBy(score, *ties).limit(k)


def _next(seq: str, pos: str, item: str) -> tuple[Column, Column]:
    w = Window.partitionBy(seq).orderBy(pos)
    return F.coalesce(F.lead(item).over(w), F.first(item).over(w)), w


def tour_length(tours: DataFrame, dist: DataFrame, seq: str = "seq_id", pos: str = "pos", item: str = "item") -> DataFrame:
    """seq, length: distances of successive stops and back to the start; null if a step has no connection."""
    after, _ = _next(seq, pos, item)
    steps = tours.withColumn("to", after)
    d = dist.filter(F.col("d") < BARRIER).select(F.col("i").alias(item), F.col("j").alias("to"), "d")
    joined = steps.join(d, [item, "to"], "left")
    return joined.groupBy(seq).agg(F.when(F.count("d") == F.count("*"), F.sum("d")).alias("length"))


def transition_counts(seqs: DataFrame, seq: str = "seq_id", pos: str = "pos", item: str = "item") -> DataFrame:
    """source (null: start), target, weight: counts over the number of sequences, the closing step included."""
    after, w = _next(seq, pos, item)
    rows = seqs.withColumns({"to": after, "rn": F.row_number().over(w)})
    n = seqs.agg(F.count_distinct(seq)).first()[0] or 1
    moves = rows.groupBy(F.col(item).alias("source"), F.col("to").alias("target")).agg((F.count("*") / n).alias("weight"))
    starts = rows.filter("rn = 1").groupBy(F.lit(None).cast(seqs.schema[item].dataType).alias("source"), F.col(item).alias("target")).agg((F.count("*") / n).alias("weight"))
    return starts.unionByName(moves)


def transition_matrix(counts: DataFrame, prior: DataFrame | None = None, alpha: float = 1.0, forbidden: DataFrame | None = None) -> DataFrame:
    """source, target, p: alpha * new + (1 - alpha) * prior, rows normalised without the diagonal."""
    rows = counts.filter(F.col("source").isNull() | (F.col("source") != F.col("target")))
    if prior is not None:
        old = prior.select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("p").alias("old"))
        both = rows.join(old, F.col("source").eqNullSafe(F.col("s")) & (F.col("target") == F.col("t")), "full")
        rows = both.select(F.when(F.col("target").isNotNull(), F.col("source")).otherwise(F.col("s")).alias("source"), F.coalesce("target", "t").alias("target"), (alpha * F.coalesce("weight", F.lit(0.0)) + (1 - alpha) * F.coalesce("old", F.lit(0.0))).alias("weight"))
    if forbidden is not None:
        bad = forbidden.select(F.col("source").alias("s"), F.col("target").alias("t"), F.lit(True).alias("bad"))
        rows = rows.join(bad, F.col("source").eqNullSafe(F.col("s")) & (F.col("target") == F.col("t")), "left").withColumn("weight", F.when(F.col("bad"), FORBIDDEN).otherwise(F.col("weight"))).drop("s", "t", "bad")
    total = rows.groupBy("source").agg(F.sum("weight").alias("total")).withColumnRenamed("source", "s")
    return rows.join(total, F.col("source").eqNullSafe(F.col("s"))).select("source", "target", (F.col("weight") / F.col("total")).alias("p"))


def ascending_score(seqs: DataFrame, value: str, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """seq, score: number of neighbours that do not fall."""
    w = Window.partitionBy(seq).orderBy(pos)
    return seqs.withColumn("up", F.coalesce((F.lag(value).over(w) <= F.col(value)).cast("long"), F.lit(0).cast("long"))).groupBy(seq).agg(F.sum("up").alias("score"))


def diversify(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropDuplicates(cols)
