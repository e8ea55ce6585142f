"""Association between columns, and graphs made from it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.helpers import materialize, uniform, uniform_below, unpivot

MEASURES = ("phi", "cc", "v", "pp", "pxy", "pyx", "hdiff")


def pair_counts(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """[by,] x, y (column names, x before y in cols), a, b (values), n: all contingency tables in one aggregate.

    The pairs are made inside each row; map-side partial aggregation absorbs them and any skew.
    """
    cell = lambda c: F.col(c).cast("string")
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), cell(x).alias("a"), cell(y).alias("b")) for i, x in enumerate(cols) for j, y in enumerate(cols) if i < j]
    names = F.array(*map(F.lit, cols))
    by = by or []
    counts = df.select(*by, F.explode(F.array(*pairs)).alias("p")).groupBy(*by, "p.i", "p.j", "p.a", "p.b").agg(F.count("*").alias("n"))
    return counts.select(*by, F.element_at(names, F.col("i") + 1).alias("x"), F.element_at(names, F.col("j") + 1).alias("y"), "a", "b", "n")


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.groupBy(x, y).agg(F.count("*").alias("n"))


def measures(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for each [by,] x, y with chi2, n and the association measures; from pair_counts().

    phi = sqrt(chi2 / n); cc = sqrt(chi2 / (chi2 + n)); v = Cramer's; pxy, pyx: relative reduction of
    Gini variance of the other column (levels weigh alike), pxy of y given x.
    """
    key = [*(by or []), "x", "y"]
    row = counts.groupBy(*key, "a").agg(F.sum("n").alias("r"), (1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("gini_y"))
    col = counts.groupBy(*key, "b").agg(F.sum("n").alias("c"), (1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("gini_x"))
    tot = lambda t, m, out, g: t.groupBy(*key).agg(F.sum(m).alias("n"), F.count("*").alias(out), F.avg(g).alias(g), (1 - F.sum(F.col(m) * F.col(m)) / (F.sum(m) * F.sum(m))).alias(f"var_{out}"))
    rows, cols = tot(row, "r", "nx", "gini_y"), tot(col, "c", "ny", "gini_x").drop("n")
    same = lambda l, r, names: F.lit(True) if not names else _and(l[k].eqNullSafe(r[k]) for k in names)
    r, c = row.select(*(F.col(k).alias(f"r_{k}") for k in [*key, "a"]), "r"), col.select(*(F.col(k).alias(f"c_{k}") for k in [*key, "b"]), "c")
    cells = counts.join(r, _and(F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in [*key, "a"])).join(c, _and(F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in [*key, "b"]))
    chi = cells.groupBy(*key).agg((F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))) - 1).alias("q"))
    out = chi.join(rows, key).join(cols, key)
    chi2 = F.greatest(F.col("n") * F.col("q"), F.lit(0.0))
    least = F.least("nx", "ny") - 1
    del same
    return out.select(
        *key, "n", "nx", "ny", chi2.alias("chi2"),
        F.sqrt(chi2 / F.col("n")).alias("phi"), F.sqrt(chi2 / (chi2 + F.col("n"))).alias("cc"),
        F.when(least > 0, F.sqrt(chi2 / F.col("n") / least)).otherwise(0.0).alias("v"),
        F.when(F.col("var_ny") > 0, (F.col("var_ny") - F.col("gini_y")) / F.col("var_ny")).otherwise(0.0).alias("pxy"),
        F.when(F.col("var_nx") > 0, (F.col("var_nx") - F.col("gini_x")) / F.col("var_nx")).otherwise(0.0).alias("pyx"),
    )


def _and(conds) -> Column:
    out = None
    for c in conds:
        out = c if out is None else out & c
    return out


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    return unpivot(df, [], cols).groupBy("col", "value").agg(F.count("*").alias("n"))


def histogram_difference(counts: DataFrame) -> DataFrame:
    """x, y, hdiff: sorted counts over their maximum, padded with 0, summed absolute differences over the longer length.

    From value_counts(); each column's counts are ranked, so pairs meet on rank and not on values.
    """
    w = Window.partitionBy("col").orderBy(F.desc("n"), "value")
    h = counts.withColumns({"rank": F.row_number().over(w), "h": F.col("n") / F.max("n").over(Window.partitionBy("col"))})
    size = h.groupBy("col").agg(F.max("rank").alias("len"), F.sum("h").alias("total"))
    a = h.select(F.col("col").alias("x"), "rank", F.col("h").alias("ha"))
    b = h.select(F.col("col").alias("y"), "rank", F.col("h").alias("hb"))
    # sum |a - b| over all ranks = total a + total b - 2 * sum min(a, b) over the common ones
    both = a.join(b, "rank").filter("x < y").groupBy("x", "y").agg(F.sum(F.least("ha", "hb")).alias("low"))
    sx, sy = size.toDF("x", "lx", "tx"), size.toDF("y", "ly", "ty")
    return both.join(sx, "x").join(sy, "y").select("x", "y", ((F.col("tx") + F.col("ty") - 2 * F.col("low")) / F.greatest("lx", "ly")).alias("hdiff"))


def repeated(df: DataFrame, measure: Callable[[DataFrame, list[str]], DataFrame], times: int, rows: int, key: list[str], by: list[str], seed: int = 0) -> DataFrame:
    """Median of each numeric column of measure(samples, ["rep"]) over ``times`` samples of ``rows`` rows.

    A replicate holds the rows with the smallest hashes of their key and its number.  A threshold on the hash, tested on the
    digits of each row and replicate as they are made, leaves a few more rows than a replicate needs; only these are
    ranked.  Keys are dealt over all tasks first, as hashing takes the time and the table may lie in one small file.  Every replicate with enough rows under the threshold is exact; else the threshold is doubled.
    """
    n = df.count()
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    share = min(1.0, (rows + 5 * math.sqrt(rows) + 10) / max(n, 1))
    while True:
        each = dealt.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(times)))).filter(uniform_below(share, *key, "rep", seed=seed))
        few = materialize(each.withColumn("u", uniform(*key, "rep", seed=seed)))
        got = few.groupBy("rep").count().agg(F.count("*").alias("reps"), F.min("count").alias("least")).first()
        if share >= 1 or got["reps"] == times and got["least"] >= min(rows, n):
            break
        share = min(1.0, 2 * share)
    w = Window.partitionBy("rep").orderBy("u", *key)
    samples = few.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= rows).drop("rn", "u")
    found = measure(samples, ["rep"])
    numeric = [f.name for f in found.schema if f.name not in [*by, "rep"]]
    return found.groupBy(*by).agg(*(F.median(c).alias(c) for c in numeric))


def association_edges(df: DataFrame, cols: list[str], weight: str = "phi", p_value: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """x, y, weight and all measures for each pair of columns, over the whole table."""
    edges = measures(pair_counts(df, cols))
    hd = histogram_difference(value_counts(df, cols))
    flip = hd.select(F.col("y").alias("x"), F.col("x").alias("y"), "hdiff")
    out = edges.join(hd.unionByName(flip), ["x", "y"]).withColumn("weight", F.col(weight))
    if p_value:
        out = out.withColumn("pp", p_value(F.col("chi2"), (F.col("nx") - 1) * (F.col("ny") - 1)))
    return out


def vertex_histograms(df: DataFrame, cols: list[str]) -> DataFrame:
    """name, freqs (relative, falling), value (sum over pairs of products of frequencies)."""
    p = value_counts(df, cols).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("col")))
    return p.groupBy(F.col("col").alias("name")).agg(F.sort_array(F.collect_list("p"), asc=False).alias("freqs"), ((1 - F.sum(F.col("p") * F.col("p"))) / 2).alias("value"))


def directed_edges(edges: DataFrame) -> DataFrame:
    """Of each pair the direction with the larger variance reduction; ties keep x -> y."""
    forward = F.greatest("pxy", F.lit(0.0)) >= F.greatest("pyx", F.lit(0.0))
    return edges.select(F.when(forward, F.col("x")).otherwise(F.col("y")).alias("source"), F.when(forward, F.col("y")).otherwise(F.col("x")).alias("target"), F.greatest("pxy", "pyx", F.lit(0.0)).alias("weight"))


def information_gain(counts: DataFrame) -> DataFrame:
    """x, y, gain (of y from x, in bits) and gain_ratio, from pair_counts()."""
    key = ["x", "y"]
    total = counts.groupBy(*key).agg(F.sum("n").alias("t"))
    h = lambda t, name: t.join(total, key).groupBy(*key).agg((-F.sum(F.col("m") / F.col("t") * F.log2(F.col("m") / F.col("t")))).alias(name))
    hx = h(counts.groupBy(*key, "a").agg(F.sum("n").alias("m")), "hx")
    hy = h(counts.groupBy(*key, "b").agg(F.sum("n").alias("m")), "hy")
    hxy = h(counts.withColumnRenamed("n", "m"), "hxy")
    gain = F.col("hx") + F.col("hy") - F.col("hxy")
    return hx.join(hy, key).join(hxy, key).select(*key, gain.alias("gain"), F.when(F.col("hx") > 0, gain / F.col("hx")).otherwise(0.0).alias("gain_ratio"))
