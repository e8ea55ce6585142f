"""Matching of column graphs, and recovery of renamed values."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.assoc import pair_counts
from sparkloom.operators.helpers import distinct_rows, global_cumsum, materialize, small_or_shuffled, uniform, unpivot
from sparkloom.operators.transport import used_capacity

#: different values of a column whose pairs of values are listed; wider columns are mapped by frequency_map
VALUES = 2000


def vertex_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """x, y, sim = 1 - |difference of values| of all vertex pairs (columns of two tables: few by nature)."""
    every = b.agg(F.collect_list(F.struct(F.col("name").alias("y"), F.col("value").alias("vy"))).alias("all"))
    rows = every.first()["all"]
    known = F.array(*(F.struct(F.lit(r["y"]).alias("y"), F.lit(r["vy"]).alias("vy")) for r in rows))
    return a.select(F.col("name").alias("x"), "value", F.explode(known).alias("o")).select("x", "o.y", (1 - F.abs(F.col("value") - F.col("o.vy"))).alias("sim"))


def both_ways(edges: DataFrame) -> DataFrame:
    """x, y, weight in both directions, zero weights left out."""
    e = edges.filter("weight <> 0").select("x", "y", "weight")
    return e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"), "weight"))


def neighbours(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("x").agg(F.sort_array(F.collect_list("y")).alias("neighbours"))


def match_exact(tree: list[tuple[str, int]], source: DataFrame, target: DataFrame, vsim: DataFrame) -> DataFrame:
    """path (array of target vertices in tree order), score: all best mappings, by one join per tree edge.

    tree: (source vertex, position of its parent; -1 for the root).  Score: vertex similarities plus
    1 - |difference of weights| of the tree's edges; target vertices are distinct.
    """
    weights = {(r["x"], r["y"]): r["weight"] for r in both_ways(source).filter(F.col("x").isin([v for v, _ in tree])).collect()}
    edges = both_ways(target).select(F.col("x").alias("__from"), F.col("y").alias("__to"), F.col("weight").alias("__w"))
    out = vsim.filter(F.col("x") == tree[0][0]).select(F.array("y").alias("path"), F.col("sim").alias("score"))
    for v, parent in tree[1:]:
        w = float(weights.get((tree[parent][0], v), 0.0))
        mine = vsim.filter(F.col("x") == v).select(F.col("y").alias("__to"), "sim")
        step = out.withColumn("__from", F.element_at("path", parent + 1)).join(edges, "__from").filter(~F.array_contains("path", F.col("__to"))).join(mine, "__to")
        out = step.select(F.concat("path", F.array("__to")).alias("path"), (F.col("score") + F.col("sim") + 1 - F.abs(w - F.col("__w"))).alias("score"))
    best = out.agg(F.max("score").alias("best"))
    return out.join(F.broadcast(best), F.abs(F.col("score") - F.col("best")) < 1e-9).select("path", "score")


def match_colored(tree: list[tuple[str, int]], source: DataFrame, target: DataFrame, vsim: DataFrame, eps: float = 0.2, seed: int = 0) -> DataFrame:
    """As match_exact, by color coding: ln(1/eps) e^k colorings, all in one plan.

    In each coloring a mapping's vertices must have different colors, a test on a bit mask; for each
    (coloring, color set, frontier) only the best path is kept, so states stay few on large graphs.
    """
    k = len(tree)
    trials = max(1, int(math.log(1 / eps) * math.exp(k)))
    weights = {(r["x"], r["y"]): r["weight"] for r in both_ways(source).filter(F.col("x").isin([v for v, _ in tree])).collect()}
    color = lambda c: F.pow(F.lit(2), F.floor(uniform("trial", c, seed=seed) * k)).cast("int")
    edges = both_ways(target).select(F.col("x").alias("__from"), F.col("y").alias("__to"), F.col("weight").alias("__w"))
    trial = F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")
    out = vsim.filter(F.col("x") == tree[0][0]).select(trial, "y", "sim").select("trial", color("y").alias("mask"), F.array("y").alias("path"), F.col("sim").alias("score"))
    for i, (v, parent) in enumerate(tree[1:], 1):
        w = float(weights.get((tree[parent][0], v), 0.0))
        mine = vsim.filter(F.col("x") == v).select(F.col("y").alias("__to"), "sim")
        step = out.withColumn("__from", F.element_at("path", parent + 1)).join(edges, "__from").join(mine, "__to").withColumn("c", color("__to")).filter(F.col("mask").bitwiseAND(F.col("c")) == 0)
        step = step.select("trial", F.col("mask").bitwiseOR(F.col("c")).alias("mask"), F.concat("path", F.array("__to")).alias("path"), (F.col("score") + F.col("sim") + 1 - F.abs(w - F.col("__w"))).alias("score"))
        # vertices that later edges start from
        open_ = [j for j in range(i + 1) if any(p == j for _, p in tree[i + 1 :])]
        frontier = F.array(*(F.element_at("path", j + 1) for j in open_)) if open_ else F.array(F.lit(""))
        step = step.withColumn("front", frontier)
        best = F.max("score").over(Window.partitionBy("trial", "mask", "front"))
        out = step.withColumn("best", best).filter(F.col("score") >= F.col("best") - 1e-9).drop("best", "front")
    out = out.select("path", "score").distinct()
    top = out.agg(F.max("score").alias("best"))
    return out.join(F.broadcast(top), F.col("score") >= F.col("best") - 1e-9).select("path", "score")


def graph_match(trees: list[list[tuple[str, int]]], match: Callable[[list[tuple[str, int]]], DataFrame]) -> DataFrame:
    """a, b, weight: scores of all trees' best mappings added up on each pair they map."""
    rows = None
    for tree in trees:
        names = F.array(*(F.lit(v) for v, _ in tree))
        part = match(tree).select("score", F.explode(F.arrays_zip(names.alias("a"), F.col("path").alias("b"))).alias("m")).select("m.a", F.col("m.b").alias("b"), "score")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("a", "b").agg(F.sum("score").alias("weight"))


def frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    n = unpivot(df, [], cols).filter("value is not null").groupBy("col", "value").agg(F.count("*").alias("n"))
    total = n.groupBy("col").agg(F.sum("n").alias("t"))
    return n.join(total, "col").select("col", "value", (F.col("n") / F.col("t")).alias("f"))


def init_value_graph(v: DataFrame, w: DataFrame, cols: list[str]) -> DataFrame:
    """col, a, b, w = 1 - |difference of relative frequencies| over the pairs of a column's values.

    A column with more than ``VALUES`` different values on either side is an error, and that bounds the pairs, the side that is
    broadcast and the matrix that best_value_map solves; frequency_map gives wider columns' best map without the pairs.
    """
    a = materialize(frequencies(v, cols).select("col", F.col("value").alias("a"), F.col("f").alias("fa")))
    b = materialize(frequencies(w, cols).select("col", F.col("value").alias("b"), F.col("f").alias("fb")))
    most = a.groupBy("col").count().unionByName(b.groupBy("col").count()).agg(F.max("count")).first()[0] or 0
    if most > VALUES:
        raise ValueError(f"a column has {most} values, pairs are listed for at most {VALUES}; see frequency_map")
    return a.join(F.broadcast(b), "col").select("col", "a", "b", (1 - F.abs(F.col("fa") - F.col("fb"))).alias("w"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost one-to-one assignment; rows <= columns (shortest augmenting paths)."""
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, at, low = i, -1, 0.0
        while True:
            slack = low + cost[row] - u[row] - v
            better = ~done & (slack < dist)
            dist[better], back[better] = slack[better], at
            at = int(np.where(done, np.inf, dist).argmin())
            low = dist[at]
            done[at] = True
            if row_of[at] < 0:
                break
            row = row_of[at]
        seen = np.flatnonzero(done & (row_of >= 0))
        u[row_of[seen]] += low - dist[seen]
        v[done] -= low - dist[done]
        u[i] += low
        while at >= 0:
            prev = back[at]
            row_of[at] = row_of[prev] if prev >= 0 else i
            at = prev
    out = np.full(n, -1)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


def best_value_map(g: DataFrame) -> DataFrame:
    """col, a, b: the one-to-one map of largest total weight in each column (a domain per group)."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        t = rows.pivot_table(index="a", columns="b", values="w", fill_value=0.0)
        flip = t.shape[0] > t.shape[1]
        m = t.to_numpy().T if flip else t.to_numpy()
        got = assignment(m.max() - m)
        a = t.index[got] if flip else t.index
        b = t.columns if flip else t.columns[got]
        return pd.DataFrame({"col": rows["col"].iloc[0], "a": list(a), "b": list(b)})

    return g.groupBy("col").applyInPandas(solve, "col string, a string, b string")


def ranked_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """col, value, n rows, place (from 1): each column's values by rising frequency, ties by value; nulls are left out."""
    n = unpivot(df, [], cols).filter("value is not null").groupBy("col", "value").agg(F.count("*").alias("n"))
    run = materialize(global_cumsum(n, [F.col("col"), F.col("n"), F.col("value")], {"upto": F.lit(1)}))
    first = run.groupBy("col").agg(F.min("upto").alias("first"))
    return run.join(F.broadcast(first), "col").select("col", "value", "n", (F.col("upto") - F.col("first") + 1).alias("place"))


def frequency_map(v: DataFrame, w: DataFrame, cols: list[str]) -> DataFrame:
    """col, a, b: a map of largest total weight over init_value_graph's pairs, for any number of values and without the pairs.

    A weight falls with the distance of two frequencies on a line, so some best map keeps the order of the values (ties by
    value), and values of one frequency are alike: only the numbers of values of each frequency decide which values of the
    larger side stay without a partner.  A column of N rows has at most sqrt(2 N) frequencies; its (frequency, number) rows are
    one group, solved exactly in whole numbers (transport.used_capacity).  The values then meet by equi-joins on their places.
    Columns without values on one side have no map.
    """
    a, b = (ranked_values(df, cols) for df in (v, w))
    classes = lambda t, side: t.groupBy("col", "n").agg(F.count("*").alias("k")).withColumn("side", F.lit(side))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        kinds = [[(int(n), int(k)) for n, k in zip(t["n"], t["k"])] for t in (rows[rows["side"] == side].sort_values("n") for side in (0, 1))]
        total = [sum(n * k for n, k in x) for x in kinds]
        wide = 0 if sum(k for _, k in kinds[0]) > sum(k for _, k in kinds[1]) else 1
        supply = {n * total[wide]: k for n, k in kinds[1 - wide]}
        capacity = {n * total[1 - wide]: k for n, k in kinds[wide]}
        line = sorted(supply.keys() | capacity.keys())
        used = dict(zip(line, used_capacity([(x, supply.get(x, 0), capacity.get(x, 0)) for x in line])))
        out, before, taken = [], 0, 0
        for n, k in kinds[wide]:
            u = used[n * total[1 - wide]]
            out.append((rows["col"].iloc[0], wide, n, before, u, taken))
            before, taken = before + k, taken + u
        return pd.DataFrame(out, columns=["col", "wide", "n", "before", "used", "taken"])

    plan = materialize(classes(a, 0).unionByName(classes(b, 1)).groupBy("col").applyInPandas(solve, "col string, wide int, n long, before long, used long, taken long"))
    partner = F.col("place") - F.col("before")
    found = []
    for wide, (large, small), names in ((0, (a, b), ("a", "b")), (1, (b, a), ("b", "a"))):
        chosen = large.join(small_or_shuffled(plan.filter(F.col("wide") == wide)), ["col", "n"]).filter(partner <= F.col("used"))
        chosen = chosen.select("col", F.col("value").alias(names[0]), (F.col("taken") + partner).alias("place"))
        found.append(chosen.join(small.select("col", "place", F.col("value").alias(names[1])), ["col", "place"]).select("col", "a", "b"))
    return found[0].unionByName(found[1])


def translate(v: DataFrame, maps: DataFrame, cols: list[str]) -> DataFrame:
    """v with each value replaced by its mapped one; values without a map become null."""
    out = v
    for c in cols:
        m = maps.filter(F.col("col") == c).select(F.col("a").alias("__a"), F.col("b").alias("__b"))
        out = out.join(m, F.col(c).cast("string") == F.col("__a"), "left").withColumn(c, F.col("__b")).drop("__a", "__b")
    return out


def value_model(w: DataFrame, cols: list[str], asked: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Naive Bayes of every column (of those asked) from all others, from one grouping of all column pairs.

    (pairs, classes): col, b, x, v, gain = ln(n + 1) of a column's value b beside value v of column x; and col, b, start, step:
    a row's score for b is start, plus the gains of its other values, minus step for each of these that w has.
    Counts are smoothed by 1, over a column's values and over all values of the other columns.
    """
    n = pair_counts(w, cols).filter("a is not null and b is not null")
    both = n.select(F.col("x").alias("col"), F.col("a").alias("value"), F.col("y").alias("x"), F.col("b").alias("v"), "n").unionByName(n.select(F.col("y").alias("col"), F.col("b").alias("value"), "x", F.col("a").alias("v"), "n"))
    pairs = materialize(both.filter(F.col("col").isin(asked or cols)).select("col", F.col("value").alias("b"), "x", "v", "n"))
    counts = materialize(unpivot(w, [], cols).filter("value is not null").groupBy("col", F.col("value").alias("b")).agg(F.count("*").alias("n")))
    # one row for each column
    sizes = {r["col"]: (r["k"], r["n"]) for r in counts.groupBy("col").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()}
    others = {c: sum(k for x, (k, _) in sizes.items() if x != c) for c in sizes}
    per = counts.sparkSession.createDataFrame([(c, math.log(n + k), float(others[c])) for c, (k, n) in sorted(sizes.items())], "col string, total double, others double")
    beside = pairs.groupBy("col", "b").agg(F.sum("n").alias("beside"))
    classes = counts.join(F.broadcast(per), "col").join(beside, ["col", "b"], "left")
    classes = classes.select("col", "b", (F.log(F.col("n") + 1.0) - F.col("total")).alias("start"), F.log(F.coalesce("beside", F.lit(0)) + F.col("others")).alias("step"))
    return pairs.select("col", "b", "x", "v", F.log(F.col("n") + 1.0).alias("gain")), materialize(classes)


def predict_values(t: DataFrame, model: tuple[DataFrame, DataFrame], cols: list[str], key: str, asked: list[str] | None = None) -> DataFrame:
    """key, col, b, p: of each row and column (asked) the probability of each of the model's values, given the row's other columns.

    All columns are scored by the same joins; values that the model hasn't seen say nothing.  A null key is no row.
    """
    pairs, classes = model
    known = classes.select(F.col("col").alias("x"), F.col("b").alias("v"))
    cells = unpivot(t, [key], cols).select(key, F.col("col").alias("x"), F.col("value").alias("v")).join(known, ["x", "v"])
    heard = cells.groupBy(key).agg(F.collect_set("x").alias("heard"))
    gains = cells.join(pairs, ["x", "v"]).groupBy(key, "col", "b").agg(F.sum("gain").alias("gain"))
    others = F.size("heard") - F.array_contains("heard", F.col("col")).cast("int")
    rows = t.select(key).filter(F.col(key).isNotNull()).distinct().join(heard, key, "left").withColumn("heard", F.coalesce("heard", F.array().cast("array<string>")))
    rows = rows.withColumn("col", F.explode(F.array(*map(F.lit, asked or cols)))).join(classes, "col")
    scored = rows.join(gains, [key, "col", "b"], "left").select(key, "col", "b", (F.col("start") + F.coalesce("gain", F.lit(0.0)) - others * F.col("step")).alias("s"))
    row = Window.partitionBy(key, "col")
    raised = scored.withColumn("e", F.exp(F.col("s") - F.max("s").over(row)))
    return raised.select(key, "col", "b", (F.col("e") / F.sum("e").over(row)).alias("p"))


def value_triples(v: DataFrame, t: DataFrame, model: tuple[DataFrame, DataFrame], cols: list[str], key: str, asked: list[str] | None = None) -> DataFrame:
    """col, a, b, p, n: V's own value of a cell beside each value that predict_values gives for it in t, the mean p and the number of cells.

    Rows of v and t meet by their key, which tells a side's rows apart; a null key is no row.  A prediction depends on a row's values
    alone, so rows are counted by the values of both sides first and predicted once for each combination.
    """
    own = [f"__{c}" for c in cols]
    both = t.select(key, *cols).join(v.select(key, *(F.col(c).alias(o) for c, o in zip(cols, own))), key)
    rows = distinct_rows(both, [*cols, *own])
    return _mean_triples(rows.select("tuple", "n", *(F.col(o).alias(c) for c, o in zip(cols, own))), rows.select("tuple", *cols), model, cols, asked)


def _mean_triples(own: DataFrame, t: DataFrame, model: tuple[DataFrame, DataFrame], cols: list[str], asked: list[str] | None) -> DataFrame:
    """As value_triples, of distinct rows: tuple, n and V's values; tuple and t's values."""
    cells = unpivot(own, ["tuple", "n"], cols).select("tuple", "n", "col", F.col("value").alias("a"))
    met = predict_values(t, model, cols, "tuple", asked).join(cells, ["tuple", "col"])
    return met.groupBy("col", "a", "b").agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("p"), F.sum("n").alias("n"))


def update_value_graph(g: DataFrame, triples: DataFrame, alpha: float = 0.5) -> DataFrame:
    """g <- (1 - alpha) g + alpha * mean score, for the cells that triples (col, a, b, p; n: how many cells, else 1) touch."""
    n = F.col("n") if "n" in triples.columns else F.lit(1)
    mean = triples.groupBy("col", "a", "b").agg((F.sum(F.col("p") * n) / F.sum(n)).alias("s"))
    return g.join(mean, ["col", "a", "b"], "left").select("col", "a", "b", F.when(F.col("s").isNull(), F.col("w")).otherwise((1 - alpha) * F.col("w") + alpha * F.col("s")).alias("w"))


def recover_values(v: DataFrame, w: DataFrame, cols: list[str], key: str, times: int = 2, alpha: float = 0.5) -> DataFrame:
    """col, a, b: V's values in terms of W's, by rounds of mapping, translating and predicting.

    Columns of more than ``VALUES`` values on a side have no list of pairs to update: frequency_map's map of them stays,
    and in the rounds they help to predict the other columns.  Rows of v with the same values are translated and predicted once.
    """
    sizes = [unpivot(t, [], cols).filter("value is not null").distinct().groupBy("col").count() for t in (v, w)]
    wide = {r["col"] for r in sizes[0].unionByName(sizes[1]).filter(F.col("count") > VALUES).collect()}
    few = [c for c in cols if c not in wide]
    fixed = materialize(frequency_map(v, w, [c for c in cols if c in wide])) if wide else None
    if not few:
        return fixed
    g = materialize(init_value_graph(v, w, few))
    maps = lambda: best_value_map(g).unionByName(fixed) if wide else best_value_map(g)
    model = value_model(w, cols, few)
    rows = distinct_rows(v.filter(F.col(key).isNotNull()), cols)
    for _ in range(times):
        turned = materialize(translate(rows, maps(), cols))
        triples = _mean_triples(rows, turned, model, cols, few)
        g = materialize(update_value_graph(g, triples, alpha))
    return maps()


def mapping_report(found: DataFrame, setting: str = "setting", weight: str | None = None) -> DataFrame:
    """setting, mean, sd of the share of right matches per run (columns setting, run, right; weight: how many matches a row stands for)."""
    n, right = F.col(weight) if weight else F.lit(1), F.col("right").cast("double")
    runs = found.groupBy(setting, "run").agg((F.sum(right * n) / F.sum(F.when(right.isNotNull(), n))).alias("share"))
    return runs.groupBy(setting).agg(F.avg("share").alias("mean"), F.stddev_samp("share").alias("sd"))
