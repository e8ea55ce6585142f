"""Private release: cell suppression, spectral swapping, noisy counts and histograms, private regression."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from sparkloom.functions.private import discrete_laplace, keyed_draw, keyed_uniform, noise_key
from sparkloom.operators import bitmaps, columns, discern
from sparkloom.operators.helpers import collapse, global_cumsum, materialize, small_or_shuffled, uniform

#: noise settings: slope above, slope below the true count
PRESETS = {"neutral": {"bp": 1.0, "bn": 1.0}, "over": {"bp": 1.0, "bn": 3.0}, "under": {"bp": 3.0, "bn": 1.0}}

#: dummies whose Gramian comes to the driver, 72 MB of doubles
DUMMIES = 3000
#: doubles that a task computes at a time
CELLS = 1 << 21


def kambiguate(df: DataFrame, attrs: list[str], k: int) -> DataFrame:
    """df with attrs suppressed to null so that each row matches at least k other rows, and suppressed: array of names.

    Greedy, for each distinct tuple: of the rows that do not match yet, those that differ in the fewest columns not
    suppressed so far decide; of their sets of columns the first in the order of attrs goes.  Rows that match
    then come for free (own duplicates from the start).  With fewer than k other rows every cell goes.

    All tuples take a step at once, by bitmaps (bitmaps.nearest): the jobs grow with the steps, at most one for each
    column, and no set of columns is listed, so any number of columns will do.
    """
    p = len(attrs)
    cols = [f"__v{i}" for i in range(p)]
    values = [F.coalesce(F.concat(F.lit("v"), F.col(a).cast("string")), F.lit("n")).alias(c) for a, c in zip(attrs, cols)]
    tuples = materialize(collapse(df, attrs).select("*", F.monotonically_increasing_id().alias("id"), *values))
    total = tuples.agg(F.sum("n")).first()[0] or 0
    # gone: a text with 1 for each suppressed column
    open_ = tuples.select("id", F.lit("0" * p).alias("gone"))
    done = []
    while total - 1 >= k:
        asked = materialize(tuples.select("id", *cols).join(open_.select("id", F.col("gone").alias("closed")), "id"))
        found = bitmaps.nearest(tuples, asked, cols)
        if not found:
            break
        step = materialize(asked.select("id", "closed").join(reduce(DataFrame.unionByName, found), "id"))
        # own rows match themselves, one of them is not another row
        done.append(step.filter((F.col("hits") > k) | (F.col("least") > p)).select("id", F.col("closed").alias("gone")))
        merged = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(p)), lambda i: F.when((F.substring("closed", i, 1) == "1") | (F.substring("others", i, 1) == "0"), "1").otherwise("0")), "")
        open_ = step.filter((F.col("hits") <= k) & (F.col("least") <= p)).select("id", merged.alias("gone"))
    state = reduce(DataFrame.unionByName, done) if done else tuples.select("id", F.lit("1" * p).alias("gone"))
    names = F.filter(F.array(*(F.when(F.substring("gone", i + 1, 1) == "1", a) for i, a in enumerate(attrs))), lambda x: x.isNotNull())
    plan = tuples.join(state, "id").select(*(F.col(a).alias(f"__{a}") for a in attrs), names.alias("suppressed"))
    on = None
    for a in attrs:
        c = F.col(a).eqNullSafe(F.col(f"__{a}"))
        on = c if on is None else on & c
    out = df.join(small_or_shuffled(materialize(plan)), on).drop(*(f"__{a}" for a in attrs))
    return out.withColumns({a: F.when(~F.array_contains("suppressed", a), F.col(a)) for a in attrs})


def match_count(released: DataFrame, original: DataFrame, attrs: list[str]) -> DataFrame:
    """Distinct released tuples with matches: rows of original equal on every cell that is not null.

    Tuples of one suppression pattern are counted by one grouping of the original on the rest.
    """
    tuples = materialize(collapse(released, attrs).withColumn("__mask", F.concat(*(F.when(F.col(a).isNull(), "0").otherwise("1") for a in attrs))))
    whole = materialize(collapse(original, attrs))
    out = None
    for (mask,) in sorted(tuples.select("__mask").distinct().collect()):
        kept = [a for a, m in zip(attrs, mask) if m == "1"]
        mine = tuples.filter(F.col("__mask") == mask)
        counts = whole.groupBy(*kept).agg(F.sum("n").alias("matches"))
        part = (mine.join(counts, kept, "left") if kept else mine.withColumn("matches", F.lit(counts.first()["matches"]))).select(*attrs, "n", "matches")
        out = part if out is None else out.unionByName(part)
    return out


def gramian(places: DataFrame, p: int) -> np.ndarray:
    """Dummy by dummy counts of the rows' arrays of places (column places), from one grouping of the pairs inside each row."""
    i = F.explode(F.transform("places", lambda x: F.struct(x.alias("i"), F.filter("places", lambda y: y >= x).alias("js")))).alias("x")
    n = places.select(i).select("x.i", F.explode("x.js").alias("j")).groupBy("i", "j").agg(F.count("*").alias("n")).toArrow()
    at = [n.column(c).to_numpy() for c in ("i", "j", "n")]
    g = np.zeros((p, p))
    g[at[0], at[1]] = at[2]
    g[at[1], at[0]] = at[2]
    return g


def spectral_swap(df: DataFrame, which: list[str], key: str, seed: int = 0) -> DataFrame:
    """key and swapped columns: the table's left singular vectors are each permuted on their own.

    Rows carry the places of their dummies, not dummy columns.  The Gramian is one grouped count; its eigenvectors
    (dummies x dummies, at most ``DUMMIES``, an error beyond) are found on the driver and go to the tasks as one array.
    Permutations rank rows by hashes through global running counts, those of all vectors in one pass, never in one
    partition.  A null cell has no dummy; every swapped cell has the value of the largest score, the first on ties, and a
    column without values stays null.
    """
    tables = {c: columns.codes(df, c) for c in which}
    sizes = [tables[c].count() for c in which]
    widths = [n if n > 2 else 1 for n in sizes]
    starts = [sum(widths[:i]) for i in range(len(which))]
    p = sum(widths)
    if p > DUMMIES:
        raise ValueError(f"{p} dummies; singular vectors are found for at most {DUMMIES}")
    # the dummy that is 1 in a row: none for a constant, one for the second of two values
    place = [F.when(F.lit(n > 2), F.col(c) + s).when(F.lit(n == 2) & (F.col(c) == 1), s) for c, n, s in zip(which, sizes, starts)]
    rows = columns.coded(df.select(key, *which), tables)
    rows = materialize(rows.select(key, F.filter(F.array(*(x.cast("int") for x in place)), lambda x: x.isNotNull()).alias("places")))
    values, v = np.linalg.eigh(gramian(rows, p))
    v = v[:, values > max(values.max(initial=0), 0) * 1e-10]
    r = v.shape[1]
    if not r:
        return df.select(key, *which)
    shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(v))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, step) for step in [max(1, CELLS // r)] for i in range(0, batch.num_rows, step)):
                lists = part.column(1)
                of = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                u = np.zeros((part.num_rows, r))
                np.add.at(u, of, shared.value[lists.flatten().to_numpy()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(u.ravel(), r).cast(pa.list_(pa.float64()))], [key, "u"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, step) for step in [max(1, CELLS // max(p, r))] for i in range(0, batch.num_rows, step)):
                back = part.column(1).flatten().to_numpy().reshape(part.num_rows, r) @ shared.value.T
                best = [back[:, s : s + n].argmax(1) if n > 2 else (back[:, s] > 1 - back[:, s]) if n == 2 else np.zeros(len(back)) for s, n in zip(starts, sizes)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(b.astype(np.int32)) for b in best)], [key, *which])

    # where each row stands, once for itself and once for each vector's values: two global orders in all
    target = global_cumsum(rows.select(key, uniform(key, seed=seed).alias("h")), [F.col("h"), F.col(key)], {"at": F.lit(1)}).select(key, "at")
    n = rows.count()
    kind = df.schema[key].dataType.simpleString()
    each = rows.mapInArrow(score, f"`{key}` {kind}, u array<double>").select(key, F.posexplode("u").alias("j", "u")).withColumn("h", uniform(key, "j", seed=seed + 1))
    source = global_cumsum(each, [F.col("j"), F.col("h"), F.col(key)], {"at": F.lit(1)}).withColumn("at", F.col("at") - F.col("j").cast("long") * n)
    # one entry for each vector
    source = source.groupBy("at").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "u"))), lambda x: x["u"]).alias("u"))
    back = target.join(source, "at").select(key, "u").mapInArrow(choose, ", ".join([f"`{key}` {kind}", *(f"`{c}` int" for c in which)]))
    return columns.decoded(back, tables).select(key, *which)


def utility(r: Column, c: Column, ap: float, bp: float, an: float, bn: float) -> Column:
    return F.when(r >= c, -bp * F.pow(r - c, ap)).otherwise(-bn * F.pow(c - r, an))


def calibrate(c: Column, eps: float, ap: float, bp: float, an: float, bn: float, rmin: int, rmax: int) -> Column:
    """eta = eps / (2 delta), delta the largest change of utility between neighbouring counts."""
    delta = F.lit(float(max(ap * bp, an * bn)))
    if an > 1:
        delta = F.greatest(delta, an * bn * F.pow(c - rmin, an - 1))
    if ap > 1:
        delta = F.greatest(delta, ap * bp * F.pow(rmax - c, ap - 1))
    return eps / (2 * delta)


def release_pmf(counts: DataFrame, count: str, eps: float, ap: float = 1.0, bp: float = 1.0, an: float = 1.0, bn: float = 1.0, rmin: int = 0, rmax: int = 2000) -> DataFrame:
    """counts with pmf: array<struct<r,p>> over r in [rmin, rmax), made inside the row."""
    c = F.greatest(F.least(F.col(count).cast("double"), F.lit(float(rmax))), F.lit(float(rmin)))
    eta = calibrate(F.col(count).cast("double"), eps, ap, bp, an, bn, rmin, rmax)
    raw = counts.withColumn("__w", F.transform(F.sequence(F.lit(rmin), F.lit(rmax - 1)), lambda r: F.struct(r.alias("r"), F.exp(eta * utility(r, c, ap, bp, an, bn)).alias("w"))))
    total = F.aggregate("__w", F.lit(0.0), lambda t, x: t + x["w"])
    out = raw.withColumn("__t", total)
    return out.withColumn("pmf", F.transform("__w", lambda x: F.struct(x["r"].alias("r"), (x["w"] / F.col("__t")).alias("p")))).drop("__w", "__t")


def pmf_summary(pmf: DataFrame) -> DataFrame:
    mean = F.aggregate("pmf", F.lit(0.0), lambda t, x: t + x["r"] * x["p"])
    square = F.aggregate("pmf", F.lit(0.0), lambda t, x: t + x["r"] * x["r"] * x["p"])
    return pmf.withColumns({"mean": mean, "variance": square - mean * mean})


def draw_release(pmf: DataFrame, key: list[str], secret: bytes) -> DataFrame:
    """pmf with released: the first r whose cumulative probability reaches a number drawn with the secret for the key."""
    u = keyed_uniform(noise_key(secret, "release"), *key)
    state = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("int").alias("r"))
    found = F.aggregate("pmf", state, lambda s, x: F.struct((s["cum"] + x["p"]).alias("cum"), F.coalesce(s["r"], F.when(s["cum"] + x["p"] >= u, x["r"])).alias("r")), lambda s: s["r"])
    return pmf.withColumn("released", F.coalesce(found, F.element_at("pmf", -1)["r"]))


def k_attributes_private(df: DataFrame, attrs: list[str], target: str, k: int, eps: float, secret: bytes, size: int) -> list[str]:
    """As discern.k_attributes, each pick drawn by the exponential mechanism with eps / k.

    One row changes a count of told-apart pairs by at most the other rows' number; ``size``, a bound on the rows
    that the caller knows beforehand, is used for it, not the table's own count.  A draw is the largest of the
    scores with Gumbel noise on each.
    """
    tuples = materialize(collapse(df.filter(F.col(target).isNotNull()), [*attrs, target]))
    noise = noise_key(secret, "picks")
    out: list[str] = []
    for turn in range(min(k, len(attrs))):
        rest = [a for a in attrs if a not in out]
        got = discern._told_apart(tuples, [[*out, a] for a in rest], target)
        noisy = [(eps / k) * x / (2 * max(size - 1, 1)) - math.log(-math.log(keyed_draw(noise, a, turn))) for a, x in zip(rest, got)]
        out.append(rest[max(range(len(rest)), key=lambda i: (noisy[i], -i))])
    return out


def budget_share(n: int, k: int, p: float = 0.95, tau: float = 0.05, share: float = 0.5) -> float:
    """Part of the budget for the histogram: enough that a cell's row survives with probability p, at most 1 - tau."""
    need = math.log(1 / (2 * (1 - p))) / max(math.log(max(n, 2)), 1e-9)
    return min(1 - tau, max(share, need / (k + 1)))


def projected_histogram(df: DataFrame, attrs: list[str], target: str, eps: float, secret: bytes, size: int, bounds: dict[str, tuple[float, float]], domain: dict[str, list], k: int = 2, bins: int = 5, a: float = 0.5, gamma: float | None = None) -> DataFrame:
    """Cells (chosen attributes, target) with a noisy, whole count over the threshold a log(size) / eps.

    Nothing but counts is read from the data: ``size`` bounds the rows, ``bounds`` are the ends of numeric attributes,
    which are scaled by them, clamped and cut in bins, and ``domain`` holds the values of all other columns; rows
    with a null or another value there belong to no cell.  k attributes are chosen privately with (1 - gamma) eps,
    the histogram gets gamma eps.  Noise goes on every cell of the domain, empty ones too.
    """
    missing = [c for c in [*attrs, target] if c not in bounds and c not in domain]
    if missing:
        raise ValueError(f"neither bounds nor a domain given for {missing}")
    kinds = {f.name: f.dataType for f in df.schema} | {c: IntegerType() for c in bounds}
    known = {c: list(range(bins)) if c in bounds else domain[c] for c in [*attrs, target]}

    def cell(c: str) -> Column:
        if c not in bounds:
            return F.when(F.col(c).isin(domain[c]), F.col(c))
        lo, hi = map(float, bounds[c])
        x = F.col(c).cast("double")
        return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.floor(F.greatest(x - lo, F.lit(0.0)) / (hi - lo) * bins), F.lit(bins - 1)).cast("int"))

    coarse = materialize(df.select(*(cell(c).alias(c) for c in [*attrs, target])).dropna())
    gamma = budget_share(size, k) if gamma is None else gamma
    picked = k_attributes_private(coarse, attrs, target, k, (1 - gamma) * eps, secret, size)
    cols = [*(a for a in attrs if a in picked), target]
    cells = df.sparkSession.range(1)
    for c in cols:
        cells = cells.withColumn(c, F.explode(F.array(*(F.lit(v).cast(kinds[c]) for v in known[c])))).repartition(c)
    cells = cells.select(*cols).join(collapse(coarse, cols), cols, "left")
    noisy = F.coalesce("n", F.lit(0)) + discrete_laplace(gamma * eps, noise_key(secret, "cells"), *cols)
    return cells.withColumn("count", noisy).filter(F.col("count") > a * math.log(max(size, 2)) / eps).select(*cols, "count")


def expand(hist: DataFrame, count: str = "count") -> DataFrame:
    """A row for each counted one."""
    return hist.filter(F.col(count) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count)))).drop(count)


def smallest_gap(df: DataFrame, col: str) -> float:
    """The smallest gap between two of the column's values, 0 without two."""
    values = df.select(F.col(col).cast("double").alias("v")).distinct().filter("v is not null")
    # gaps inside range partitions, then those between one partition's last value and the next one's first
    parts = materialize(values.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v").withColumn("p", F.spark_partition_id()))
    inside = parts.withColumn("g", F.col("v") - F.lag("v").over(Window.partitionBy("p").orderBy("v"))).groupBy("p").agg(F.min("g").alias("g"), F.min("v").alias("first"), F.max("v").alias("last"))
    gap = inside.select(F.least("g", F.col("first") - F.lag("last").over(Window.orderBy("p"))).alias("g")).agg(F.min("g")).first()[0]
    return float(gap or 0.0)


def jitter(df: DataFrame, col: str, amount: float, key: list[str], secret: bytes, gap: float) -> DataFrame:
    """Uniform noise within amount * gap / 5; gap is the distance of the discretised values, which the caller knows (smallest_gap reads it from public values)."""
    return df.withColumn(col, F.col(col) + (keyed_uniform(noise_key(secret, "jitter"), *key) * 2 - 1) * (amount * gap / 5))


def private_logistic(df: DataFrame, response: str, covariates: list[str], eps: float, secret: bytes, lam: float = 0.1) -> DataFrame:
    """name, coefficient: regularised logistic regression on unit-norm rows with output perturbation.

    Noise has density falling as exp(-eps n lam |b| / 2): a uniform direction and a gamma length, drawn with the secret.
    """
    x = F.array(F.lit(1.0), *(F.col(c).cast("double") for c in covariates))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v))
    rows = df.dropna(subset=[response, *covariates]).select(array_to_vector(F.transform(x, lambda v: v / norm)).alias("x"), F.col(response).cast("double").alias("y"))
    n = rows.count()
    fit = LogisticRegression(featuresCol="x", labelCol="y", regParam=lam, fitIntercept=False, standardization=False).fit(rows)
    noise, names = noise_key(secret, "coefficients"), ["(intercept)", *covariates]
    # normal numbers for the direction; a gamma length of whole shape is a sum of exponential ones
    b = np.array([math.sqrt(-2 * math.log(keyed_draw(noise, "r", i))) * math.cos(2 * math.pi * keyed_draw(noise, "t", i)) for i in range(len(names))])
    length = -sum(math.log(keyed_draw(noise, "e", i)) for i in range(len(names))) * 2 / (eps * n * lam)
    b *= length / np.linalg.norm(b)
    return df.sparkSession.createDataFrame([(c, float(w + e)) for c, w, e in zip(names, fit.coefficients, b)], "name string, coefficient double")
