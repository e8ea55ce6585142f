"""Predicates, scaling, dummies, binning and membership functions on columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import sketches
from sparkloom.operators.helpers import global_cumsum, hold_by_hash, materialize, small_or_shuffled, uniform

#: values of a column's domain that may come to the driver
DOMAIN_LIMIT = 10_000


def indiscernible(a: Column, b: Column) -> Column:
    """Equal, or one of them missing."""
    return a.isNull() | b.isNull() | (a == b)


def crisp(a: Column, value: Column | str | float) -> Column:
    """1 where a is value, 0 where it is another or missing."""
    return F.coalesce((a == value).cast("double"), F.lit(0.0))


def unit(x: Column, low: float, high: float) -> Column:
    """x scaled from [low, high] to [0, 1]; 0 for an empty range."""
    return (x - low) / (high - low) if high > low else F.when(x.isNotNull(), 0.0)


def scale_unit(df: DataFrame, cols: list[str]) -> DataFrame:
    ends = df.agg(*(f(c).cast("double").alias(f"{c}_{f.__name__}") for c in cols for f in (F.min, F.max))).first()
    return df.withColumns({c: unit(F.col(c).cast("double"), ends[f"{c}_min"] or 0.0, ends[f"{c}_max"] or 0.0) for c in cols})


def domains(df: DataFrame, cols: list[str]) -> dict[str, list]:
    """Sorted distinct values of each column, nulls left out. No more than one over the limit come to the driver."""
    out = {}
    for c in cols:
        found = [r[0] for r in df.filter(F.col(c).isNotNull()).select(c).distinct().limit(DOMAIN_LIMIT + 1).collect()]
        if len(found) > DOMAIN_LIMIT:
            raise ValueError(f"{c} has more than {DOMAIN_LIMIT} values; it is no factor")
        out[c] = sorted(found)
    return out


def dummies(col: str, domain: list) -> list[Column]:
    """One 0 column for one value, one 0/1 column for two, one-hot for more."""
    if len(domain) < 2:
        return [F.lit(0.0).alias(f"{col}_0")]
    if len(domain) == 2:
        return [(F.col(col) != domain[0]).cast("double").alias(f"{col}_0")]
    return [(F.col(col) == v).cast("double").alias(f"{col}_{i}") for i, v in enumerate(domain)]


def dummify(df: DataFrame, which: list[str], known: dict[str, list] | None = None) -> DataFrame:
    """df with the columns in which replaced by their dummies, in place."""
    known = known or domains(df, which)
    return df.select(*(x for c in df.columns for x in (dummies(c, known[c]) if c in known else [F.col(c)])))


def _scores(col: str, domain: list) -> Column:
    if len(domain) < 2:
        return F.array(F.lit(1.0))
    if len(domain) == 2:
        return F.array(1 - F.col(f"{col}_0"), F.col(f"{col}_0"))
    return F.array(*(F.col(f"{col}_{i}") for i in range(len(domain))))


def restore(df: DataFrame, known: dict[str, list], strategy: str = "maxi", key: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Values back from dummy scores: the largest (first on ties), or drawn in proportion ("wheel").

    The wheel takes negative scores as 0 and draws evenly when all are 0; key makes the draw repeatable.
    """
    out = {}
    for n, (col, domain) in enumerate(known.items()):
        values = F.array(*map(F.lit, domain))
        score = _scores(col, domain)
        if strategy == "maxi":
            at = F.array_position(score, F.array_max(score)).cast("int")
        else:
            fair = F.transform(score, lambda x: F.greatest(x, F.lit(0.0)))
            fair = F.when(F.aggregate(fair, F.lit(0.0), lambda t, x: t + x) > 0, fair).otherwise(F.transform(score, lambda x: F.lit(1.0)))
            u = uniform(*(key or df.columns), seed=seed + n)
            steps = F.aggregate(fair, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
            at = F.size(F.filter(F.slice(steps, 2, len(domain)), lambda x: x < u * F.element_at(steps, -1))) + 1
        out[col] = F.element_at(values, at)
    drop = {f"{c}_{i}" for c, d in known.items() for i in range(max(1, len(d) if len(d) > 2 else 1))}
    return df.withColumns(out).drop(*drop)


def codes(df: DataFrame, col: str) -> DataFrame:
    """value, at: the place (from 0) of each of a column's values in their order, for any number of values; nulls left out."""
    values = df.filter(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    return materialize(global_cumsum(values, [F.col("value")], {"upto": F.lit(1)}).select("value", (F.col("upto") - 1).cast("int").alias("at")))


def coded(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """df with each column of tables (codes) replaced by its value's place: dummify in sparse form, as the place says which dummy is 1.

    Nulls and values that are not in the table become null.
    """
    out = df
    for c, t in tables.items():
        out = out.join(small_or_shuffled(t.select(F.col("value").alias("__value"), F.col("at").alias("__at"))), F.col(c) == F.col("__value"), "left").withColumn(c, F.col("__at")).drop("__value", "__at")
    return out


def decoded(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Values back from places; a place that is null or not in the table becomes null."""
    return coded(df, {c: t.select(F.col("at").alias("value"), F.col("value").alias("at")) for c, t in tables.items()})


def quantiles(df: DataFrame, cols: list[str], at: list[float], known: DataFrame | None = None) -> dict[str, tuple[list[float], int]]:
    """Quantiles of each column, interpolated linearly, and its number of different values; nulls are left out.

    All columns are counted by value in one job and put in order by range partitions with running counts; only the
    two values on either side of each quantile come to the driver.  A column without values has none.

    known: stored sketches of the columns (sketches.stored), which are asked instead, within their rank error; df is not read then.
    """
    if known is not None:
        return sketches.quantiles(known, cols, at)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value")) for c in cols)))
    counts = df.select(cells.alias("x")).select("x.*").filter("value is not null").groupBy("col", "value").agg(F.count("*").alias("n"))
    run = materialize(global_cumsum(counts, [F.col("col"), F.col("value")], {"upto": F.col("n")}))
    sizes = {r["col"]: r for r in run.groupBy("col").agg(F.sum("n").alias("n"), F.count("*").alias("values"), F.max("upto").alias("end")).collect()}
    wanted = []
    for c, r in sizes.items():
        for i, p in enumerate(at):
            place = p * (r["n"] - 1)
            low = math.floor(place)
            wanted += [(c, i, r["end"] - r["n"] + low + 1, 1 - (place - low)), (c, i, r["end"] - r["n"] + min(low + 2, r["n"]), place - low)]
    if not wanted:
        return {c: ([], 0) for c in cols}
    marks = df.sparkSession.createDataFrame(wanted, "col string, i int, rank long, share double")
    hit = run.join(F.broadcast(marks), "col").filter("rank <= upto and rank > upto - n").groupBy("col", "i").agg(F.sum(F.col("value") * F.col("share")).alias("q"))
    found = {(r["col"], r["i"]): r["q"] for r in hit.collect()}
    return {c: ([found[c, i] for i in range(len(at))], sizes[c]["values"]) if c in sizes else ([], 0) for c in cols}


def cuts_between_quantiles(df: DataFrame, cols: list[str], levels: int, known: DataFrame | None = None) -> dict[str, list[float] | None]:
    """Midpoints of neighbouring quantiles at 0, 1/(levels-1), .., 1; None where a column has at most levels values."""
    found = quantiles(df, cols, [i / (levels - 1) for i in range(levels)], known)
    return {c: None if n <= levels else [(a + b) / 2 for a, b in zip(q, q[1:])] for c, (q, n) in found.items()}


def level(x: Column, cuts: list[float]) -> Column:
    """Number of cuts strictly below x."""
    return F.when(x.isNotNull(), sum(((x > c).cast("int") for c in cuts), F.lit(0)))


def cuts_inner_quantiles(df: DataFrame, cols: list[str], n: int, known: DataFrame | None = None) -> dict[str, list[float]]:
    """n quantiles at (i + 1) / (n + 1), interpolated linearly."""
    return {c: q for c, (q, _) in quantiles(df, cols, [(i + 1) / (n + 1) for i in range(n)], known).items()}


def cuts_equal_width(df: DataFrame, cols: list[str], n: int) -> dict[str, list[float]]:
    """n evenly spaced inner cuts of [min, max]."""
    row = df.agg(*(F.min(c).cast("double").alias(f"a_{c}") for c in cols), *(F.max(c).cast("double").alias(f"b_{c}") for c in cols)).first()
    return {c: [row[f"a_{c}"] + (row[f"b_{c}"] - row[f"a_{c}"]) * (i + 1) / (n + 1) for i in range(n)] for c in cols}


def _rise(x: Column, low: float, high: float, variant: str) -> Column:
    if low == -math.inf:
        return F.lit(1.0)
    if high == math.inf:
        return F.lit(0.0)
    if low == high:
        return ((x >= low) if variant == "closed" else (x > low)).cast("double")
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def membership(x: Column, left: float, top: float, right: float, height: float = 1.0, variant: str = "step") -> Column:
    """Triangle or shoulder (infinite ends) over x.

    Variants differ where left = top or top = right: "step" and "open" are 0 at the point itself on the
    rise, "closed" is 1 there.  A missing value gives null, in "closed" what a value below all points gives.
    """
    up = _rise(x, left, top, variant)
    down = 1 - _rise(x, top, right, variant)
    value = F.least(up, down) * height
    if variant == "closed":
        low = height * min(1.0 if left == -math.inf else 0.0, 1.0)
        # the rise of a missing value is 0: an inner or left-shoulder set gets 1, a right shoulder 0
        return F.coalesce(F.when(x.isNotNull(), value), F.lit(0.0 if right == math.inf and left != -math.inf else height if low or right != math.inf else 0.0))
    return F.when(x.isNotNull(), value)


def membership_table(df: DataFrame, cols: list[str], levels: int, known: DataFrame | None = None) -> list[tuple[str, int, float, float, float]]:
    """(column, level, left, top, right) over the quantiles, with infinite shoulders."""
    found = quantiles(df, cols, [i / (levels - 1) for i in range(levels)], known)
    out = []
    for c in cols:
        points = [-math.inf, *found[c][0], math.inf]
        out += [(c, r, points[r], points[r + 1], points[r + 2]) for r in range(levels)]
    return out


def strongest(values: list[Column]) -> Column:
    """Number of the largest value; the first wins ties."""
    every = F.array(*values)
    return (F.array_position(every, F.array_max(every)) - 1).cast("int")


def discretize_fuzzy(df: DataFrame, cols: list[str], n: int = 3, known: DataFrame | None = None) -> DataFrame:
    """Columns with more than n values become the number of their strongest triangle; others stay."""
    found = quantiles(df, cols, [(i + 1) / (n + 1) for i in range(n)], known)
    out = {}
    for c in [c for c in cols if found[c][1] > n]:
        points = [-math.inf, *found[c][0], math.inf]
        out[c] = strongest([membership(F.col(c).cast("double"), *points[r : r + 3], variant="closed") for r in range(n)])
    return df.withColumns(out) if out else df


def sample_subtable(df: DataFrame, fraction: float, key: list[str], seed: int = 0) -> DataFrame:
    """ceil(fraction * rows) rows and ceil(fraction * columns) columns, constant columns left out."""
    picked = hold_by_hash(df, F.ceil(F.lit(fraction) * F.col("n")), key, seed=seed).filter("held").drop("held")
    order = df.sparkSession.range(len(df.columns)).select("id", uniform("id", seed=seed + 1).alias("u")).orderBy("u").collect()
    cols = [df.columns[r["id"]] for r in order[: math.ceil(fraction * len(df.columns))]]
    varied = picked.agg(*((F.min(c) != F.max(c)).alias(c) for c in cols)).first()
    return picked.select(*(c for c in df.columns if c in cols and varied[c]))


class Processors:
    """Named computations over a filtered and projected table, each with an edit of the request."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[Callable, Callable | None, dict]] = {}

    def register(self, name: str, f: Callable[..., DataFrame], edit: Callable | None = None, meta: dict[str, dict] | None = None) -> None:
        """meta: parameter -> type, default, low, high."""
        self.known[name] = (f, edit, meta or {})

    def run(self, df: DataFrame, name: str, predicate: Column | None = None, projection: list[str] | None = None, **given) -> DataFrame:
        f, edit, meta = self.known[name]
        if edit:
            predicate, projection = edit(predicate, projection)
        args = {}
        for k, m in meta.items():
            v = m["type"](given.get(k, m.get("default")))
            if not m.get("low", v) <= v <= m.get("high", v):
                raise ValueError(f"{k} is out of bounds")
            args[k] = v
        df = df.filter(predicate) if predicate is not None else df
        return f(df.select(*projection) if projection else df, **args)
