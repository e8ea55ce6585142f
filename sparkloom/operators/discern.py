"""Which rows differ on which columns; set cover; small attribute lists that tell rows apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.columns import indiscernible
from sparkloom.operators.helpers import collapse, materialize, small_or_shuffled

def equivalence_classes(df: DataFrame, attrs: list[str]) -> DataFrame:
    return collapse(df, attrs)


def _pairs(n: Column) -> Column:
    """Unordered pairs across classes of n rows."""
    n = n.cast("decimal(38,0)")
    return ((F.sum(n) * F.sum(n) - F.sum(n * n)) / 2).cast("long")


def discerned_pairs(df: DataFrame, attrs: list[str]) -> DataFrame:
    """One row: pairs of rows that differ on some column of attrs (a null is a value of its own here)."""
    return collapse(df, attrs).agg(F.coalesce(_pairs(F.col("n")), F.lit(0)).alias("pairs"))


def discerned_pairs_missing(df: DataFrame, attrs: list[str]) -> DataFrame:
    """As discerned_pairs, but a null equals everything.

    Two rows agree if they are equal on the columns that neither misses.  Distinct tuples are dealt to every
    pattern of missing columns that the table has, by their values on the columns that both patterns
    hold, and agreeing pairs are counted there, all patterns in one aggregate.
    """
    tuples = materialize(collapse(df, attrs).withColumn("mask", _present(attrs)))
    masks = sorted(r[0] for r in tuples.select("mask").distinct().collect())
    total = int(tuples.agg(F.sum(F.col("n").cast("decimal(38,0)"))).first()[0] or 0)
    other = F.explode(F.array(*map(F.lit, masks or [0]))).alias("other")
    dealt = tuples.select(*attrs, "n", "mask", other).select(F.least("mask", "other").alias("a"), F.greatest("mask", "other").alias("b"), (F.col("mask") <= F.col("other")).alias("left"), (F.col("mask") == F.col("other")).alias("own"), _on(attrs, F.col("mask").bitwiseAND(F.col("other"))).alias("key"), F.col("n").cast("decimal(38,0)").alias("n"))
    met = dealt.groupBy("a", "b", "own", "key").agg(F.sum(F.when(F.col("left"), F.col("n"))).alias("x"), F.sum(F.when(~F.col("left"), F.col("n"))).alias("y"))
    # ordered pairs, a row with itself included
    same = met.agg(F.sum(F.when(F.col("own"), F.col("x") * F.col("x")).otherwise(2 * F.col("x") * F.col("y")))).first()[0] or 0
    return df.sparkSession.createDataFrame([((total**2 - int(same)) // 2,)], "pairs long")


def _present(attrs: list[str]) -> Column:
    """Bit i is set where attrs[i] is not null."""
    return sum((F.when(F.col(a).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, a in enumerate(attrs)), F.lit(0)).cast("long")


def _on(attrs: list[str], chosen: Column) -> Column:
    """The values of the attributes whose bits are set, as text; others are left out, nulls are a value."""
    return F.to_json(F.array(*(F.when(chosen.bitwiseAND(F.lit(1 << i)) != 0, F.coalesce(F.concat(F.lit("v"), F.col(a).cast("string")), F.lit("n"))).otherwise("") for i, a in enumerate(attrs))))


def pair_set(df: DataFrame, key: str, attr: str, others: list[str] | None = None) -> DataFrame:
    """(x, y), x < y: pairs that differ on attr. For small inputs; discerned_pairs counts them at any size."""
    a = df.select(F.col(key).alias("x"), F.col(attr).alias("a"))
    b = df.select(F.col(key).alias("y"), F.col(attr).alias("b"))
    return a.join(b, (F.col("x") < F.col("y")) & ~indiscernible(F.col("a"), F.col("b"))).select("x", "y")


def discerned_from(df: DataFrame, row: dict, attr: str, label: str) -> DataFrame:
    """Rows of another class than row that differ from it on attr."""
    return df.filter(~indiscernible(F.col(attr), F.lit(row[attr])) & (F.col(label) != row[label]))


def differing(df: DataFrame, row: dict, attrs: list[str]) -> DataFrame:
    """df with the column names on which each row differs from row."""
    names = F.filter(F.array(*(F.when(~F.col(a).eqNullSafe(F.lit(row[a])), a) for a in attrs)), lambda x: x.isNotNull())
    return df.withColumn("differs", names)


#: sets whose gains are followed exactly between two counts of all sets; what they share is counted in 2^LEADERS classes at most
LEADERS = 16


def _shared(left: DataFrame, leaders: list) -> list[tuple[int, int]]:
    """(bits of the leaders that hold an element, elements) for the elements of the leaders."""
    bit = F.lit(0)
    for i, x in enumerate(leaders):
        bit = F.when(F.col("set_id") == F.lit(x), 1 << i).otherwise(bit)
    each = left.filter(F.col("set_id").isin(leaders)).groupBy("element").agg(F.sum(bit).alias("bits"))
    return [(r["bits"], r["n"]) for r in each.groupBy("bits").agg(F.count("*").alias("n")).collect()]


def greedy_cover(sets: DataFrame, tau: float = 1.0, cost: DataFrame | dict | None = None) -> list:
    """Ids of sets (set_id, element) that cover a fraction tau of all elements, most new elements first.

    Ties go to the lowest id.  With cost (set_id, cost), gain / cost decides and ties go to the highest id.

    Gains only fall, so a count of all sets bounds them from then on.  The ``LEADERS`` first sets are followed exactly, by the
    number of elements in each class of them, and picked as long as the best is ahead of the first set behind
    them; only then all sets are counted again, over what is left.  Picks are those of a count for each.
    """
    left = materialize(sets.select("set_id", "element").distinct())
    total = left.select("element").distinct().count()
    gone, out = 0, []
    price = F.lit(1.0)
    if cost is not None:
        prices = left.sparkSession.createDataFrame([(k, float(v)) for k, v in cost.items()], f"set_id {left.schema['set_id'].dataType.simpleString()}, cost double") if isinstance(cost, dict) else cost.select("set_id", F.col("cost").cast("double").alias("cost"))
        left = materialize(left.join(small_or_shuffled(prices), "set_id"))
        price = F.first("cost")
    while gone < tau * total:
        gains = left.groupBy("set_id").agg(F.count("*").alias("c"), price.alias("price"))
        order = [F.desc(F.col("c") / F.col("price")), F.asc("set_id") if cost is None else F.desc("set_id")]
        top = gains.orderBy(*order).limit(LEADERS + 1).collect()
        if not top:
            break
        lead, behind = top[:LEADERS], top[LEADERS:]
        ahead = lambda x, y: x[0] > y[0] or x[0] == y[0] and (x[1] < y[1] if cost is None else x[1] > y[1])
        classes = _shared(left, [r["set_id"] for r in lead])
        picked = []
        while gone < tau * total:
            count = [sum(n for bits, n in classes if bits >> i & 1) for i in range(len(lead))]
            best = None
            for i, r in enumerate(lead):
                if count[i] and (best is None or ahead((count[i] / r["price"], r["set_id"]), (count[best] / lead[best]["price"], lead[best]["set_id"]))):
                    best = i
            if best is None or behind and not ahead((count[best] / lead[best]["price"], lead[best]["set_id"]), (behind[0]["c"] / behind[0]["price"], behind[0]["set_id"])):
                break
            picked.append(lead[best]["set_id"])
            gone += count[best]
            classes = [(bits, n) for bits, n in classes if not bits >> best & 1]
        out += picked
        if gone < tau * total:
            left = materialize(left.join(left.filter(F.col("set_id").isin(picked)).select("element").distinct(), "element", "left_anti"))
    return out


def min_union(sets: DataFrame, k: int) -> list[int]:
    """k sets, each adding least to the union so far (lowest id on ties); nothing if there are fewer.

    The ``LEADERS`` sets that add least are followed exactly, as in greedy_cover.  Another set's share of new elements falls by no
    more than the union has grown since all were counted; while that can't bring it ahead, the next is picked.
    """
    ids = materialize(sets.select("set_id").distinct())
    if ids.count() < k:
        return []
    out: list[int] = []
    left = materialize(sets.filter(F.col("element").isNotNull()).select("set_id", "element").distinct())
    while len(out) < k:
        adds = ids.filter(~F.col("set_id").isin(out)).join(left.groupBy("set_id").agg(F.count("*").alias("c")), "set_id", "left").select("set_id", F.coalesce("c", F.lit(0)).alias("c"))
        top = adds.orderBy("c", "set_id").limit(LEADERS + 1).collect()
        lead, behind = top[:LEADERS], top[LEADERS:]
        classes = _shared(left, [r["set_id"] for r in lead])
        grown, picked = 0, []
        while len(out) + len(picked) < k:
            rest = [(sum(n for bits, n in classes if bits >> i & 1), r["set_id"], i) for i, r in enumerate(lead) if r["set_id"] not in picked]
            if not rest:
                break
            c, x, best = min(rest)
            if behind and (c > behind[0]["c"] - grown or c == behind[0]["c"] - grown and (grown or x > behind[0]["set_id"])):
                break
            picked.append(x)
            grown += c
            classes = [(bits, n) for bits, n in classes if not bits >> best & 1]
        out += picked
        if len(out) < k:
            left = materialize(left.join(left.filter(F.col("set_id").isin(picked)).select("element").distinct(), "element", "left_anti"))
    return out


def _told_apart(tuples: DataFrame, sets: list[list[str]], label: str) -> list[int]:
    """For each attribute set, the pairs of different label that it tells apart; one job through grouping sets."""
    marked = [F.array(*(F.struct(F.lit(i).alias("i"), F.to_json(F.struct(*(F.col(a) for a in s)), {"ignoreNullFields": "false"}).alias("v")) for i, s in enumerate(sets)))]
    rows = tuples.select(label, "n", F.explode(*marked).alias("g")).groupBy("g.i", "g.v", label).agg(F.sum("n").alias("n"))
    within = rows.groupBy("i", "v").agg(((F.sum(F.col("n").cast("decimal(38,0)")) * F.sum("n") - F.sum(F.col("n").cast("decimal(38,0)") * F.col("n"))) / 2).alias("same"))
    same = {r["i"]: r["s"] for r in within.groupBy("i").agg(F.sum("same").alias("s")).collect()}
    total = tuples.groupBy(label).agg(F.sum("n").alias("n")).agg(_pairs(F.col("n"))).first()[0] or 0
    return [int(total - (same.get(i) or 0)) for i in range(len(sets))]


def min_attributes(df: DataFrame, attrs: list[str], label: str, tau: float = 1.0) -> list[str]:
    """A greedy short attribute list that tells apart a fraction tau of what all attributes can.

    Pairs are of rows with different, non-null labels; ties go to the first attribute.
    """
    tuples = materialize(collapse(df.filter(F.col(label).isNotNull()), [*attrs, label]))
    goal = tau * _told_apart(tuples, [attrs], label)[0]
    out: list[str] = []
    done = 0
    while done < goal and len(out) < len(attrs):
        rest = [a for a in attrs if a not in out]
        got = _told_apart(tuples, [[*out, a] for a in rest], label)
        best = max(range(len(rest)), key=lambda i: (got[i], -i))
        if got[best] <= done:
            break
        out, done = [*out, rest[best]], got[best]
    return out


def k_attributes(df: DataFrame, attrs: list[str], target: str, k: int) -> tuple[list[str], int]:
    """k attributes chosen greedily for the pairs they tell apart, and the pairs left."""
    tuples = materialize(collapse(df.filter(F.col(target).isNotNull()), [*attrs, target]))
    out: list[str] = []
    total = tuples.groupBy(target).agg(F.sum("n").alias("n")).agg(_pairs(F.col("n"))).first()[0] or 0
    done = 0
    for _ in range(min(k, len(attrs))):
        rest = [a for a in attrs if a not in out]
        got = _told_apart(tuples, [[*out, a] for a in rest], target)
        best = max(range(len(rest)), key=lambda i: (got[i], -i))
        out, done = [*out, rest[best]], got[best]
    return out, int(total - done)


def needed_attributes(df: DataFrame, attrs: list[str], target: str, tau: float = 0.1) -> int:
    """How many attributes tell apart a fraction 1 - tau of the target's pairs."""
    return len(min_attributes(df, attrs, target, 1 - tau))


def agreeing(others: DataFrame, asked: DataFrame, attrs: list[str], wild: bool, label: str | None = None) -> DataFrame:
    """asked (id, chosen: bits of attributes, attrs) with agree: rows of others (attrs, n) with its values on chosen.

    wild: a null agrees with everything, else it is a value.  label: only rows with another value there count.
    Nothing meets all with all: others are counted by their values on each chosen set that is asked for (and
    each pattern of missing columns), and asked rows look their count up.
    """
    sets = sorted(r[0] for r in asked.select("chosen").distinct().collect())
    every = (1 << len(attrs)) - 1
    own = _present(attrs) if wild else F.lit(every).cast("long")
    patterns = sorted(r[0] for r in others.select(own.alias("p")).distinct().collect())
    if not sets or not patterns:
        return asked.withColumn("agree", F.lit(0).cast("long"))
    # a pair of patterns compares the chosen columns that both have
    mine = [r[0] for r in asked.select(own.alias("p")).distinct().collect()] if wild else [every]
    shared = sorted({s & p & q for s in sets for p in patterns for q in mine})
    by = [F.col(label)] if label else [F.lit(0)]
    cells = others.select(*attrs, own.alias("__p"), by[0].alias("__l"), F.col("n").alias("__n"), F.explode(F.array(*(F.lit(s).cast("long") for s in shared))).alias("__e"))
    cells = cells.filter(F.col("__e").bitwiseAND(F.col("__p")) == F.col("__e")).withColumn("__k", _on(attrs, F.col("__e")))
    counts = cells.groupBy("__p", "__e", "__k", "__l").agg(F.sum("__n").alias("__n"))
    keys = F.explode(F.array(*(F.lit(p).cast("long") for p in patterns))).alias("__p")
    need = asked.select(*asked.columns, own.alias("__q"), by[0].alias("__l"), keys)
    need = need.withColumn("__e", F.col("chosen").bitwiseAND(F.col("__p")).bitwiseAND(F.col("__q"))).withColumn("__k", _on(attrs, F.col("__e")))
    whole = counts.groupBy("__p", "__e", "__k").agg(F.sum("__n").alias("__all"))
    met = need.join(whole, ["__p", "__e", "__k"], "left")
    if label:
        met = met.join(counts.withColumnRenamed("__n", "__same"), ["__p", "__e", "__k", "__l"], "left")
    else:
        met = met.withColumn("__same", F.lit(0))
    return met.groupBy(*asked.columns).agg(F.sum(F.coalesce("__all", F.lit(0)) - F.coalesce("__same", F.lit(0))).alias("agree"))


def min_attributes_by_row(df: DataFrame, attrs: list[str], label: str, tau: float = 1.0) -> DataFrame:
    """Distinct tuples (attrs, label, n) with needed: array of attributes that tell the tuple from other classes.

    A null is told from nothing; a tuple with a null label, or that nothing tells apart, gets an empty list.
    Attributes are added greedily, the first on ties, until a fraction tau of the rows of other classes that all attributes tell
    apart is told.

    Rows lie in the classes of partitions that are refined from pick to pick.  A class is named by a pattern of
    missing attributes and by the values of its rows on the attributes picked so far; a tuple asks one class
    of each pattern, that of the rows not told from it yet.  An attribute's gain is the rows of other labels there with
    another value, from counts grouped by class, attribute, value and label.  A pick refines only classes that
    are still asked for, and leaves out what no open tuple asks.  A pick costs three written tables, however many lists are in use.
    """
    p = len(attrs)
    tuples = materialize(collapse(df, [*attrs, label]).withColumn("__id", F.monotonically_increasing_id()))
    values = F.array(*(F.concat(F.lit("v"), F.col(a).cast("string")) for a in attrs))
    pattern = F.array_join(F.transform(values, lambda v: F.when(v.isNull(), "0").otherwise("1")), "")
    rows = tuples.filter(F.col(label).isNotNull()).select("__id", F.col(label).alias("y"), "n", values.alias("vals"), pattern.alias("cls"))
    others = rows.groupBy("cls", "y", "vals").agg(F.sum("n").alias("n"))
    patterns = [r[0] for r in others.select("cls").distinct().collect()]
    labels = others.groupBy("y").agg(F.sum("n").alias("mine"))
    total = labels.agg(F.sum("mine")).first()[0] or 0
    left = F.lit(total) - F.col("mine")
    asks = rows.drop("cls", "n").join(labels, "y").select("__id", "y", "vals", left.alias("left"))
    if tau < 1:  # the rows that nothing tells apart aren't demanded
        every = tuples.filter(F.col(label).isNotNull()).withColumn("chosen", F.lit((1 << p) - 1).cast("long")).select("__id", *attrs, label, "chosen")
        never = agreeing(tuples.filter(F.col(label).isNotNull()), every, attrs, True, label).select("__id", F.col("agree").alias("never"))
        asks = asks.join(never, "__id").select("__id", "y", "vals", "left", (F.col("left") - tau * (F.col("left") - F.col("never"))).alias("goal"))
    else:
        asks = asks.withColumn("goal", F.lit(0.0))
    asks = asks.withColumn("cls", F.explode(F.array(*map(F.lit, patterns)))) if patterns else asks.withColumn("cls", F.lit(""))
    named = lambda a, v: F.concat("cls", F.lit("|"), a.cast("string"), F.lit("="), F.length(v).cast("string"), F.lit(":"), v)
    picks = []
    for step in range(p):
        asks = materialize(asks.filter(F.col("left") > F.col("goal")))
        if not asks.limit(1).count():
            break
        # of all classes asked for, the rows; of classes refined now, those with the picked value
        here = F.explode(F.concat(F.array("cls"), F.transform(F.filter(F.transform("vals", lambda v, a: F.struct(a.alias("a"), v.alias("v"))), lambda x: x["v"].isNotNull()), lambda x: named(x["a"], x["v"]))))
        others = (others.select(here.alias("cls"), "y", "vals", "n") if step else others).join(asks.select("cls").distinct(), "cls", "left_semi")
        # a class may be refined at a later pick too, to one that is there already
        others = materialize(others.dropDuplicates(["cls", "y", "vals"]))
        cell = F.posexplode("vals").alias("a", "v")
        want = asks.select("__id", "cls", "y", cell).filter("v is not null")
        count = others.select("cls", "y", "n", cell).filter("v is not null").unionByName(want.select("cls", "y", F.lit(0).cast("long").alias("n"), "a", "v")).groupBy("cls", "a", "v", "y").agg(F.sum("n").alias("n"))
        told = count
        for name, by in (("all", ["cls", "a"]), ("value", ["cls", "a", "v"]), ("label", ["cls", "a", "y"])):
            told = told.join(count.groupBy(*by).agg(F.sum("n").alias(name)), by)
        told = told.select("cls", "a", "v", "y", (F.col("all") - F.col("value") - F.col("label") + F.col("n")).alias("gain")).filter("gain > 0")
        best = want.join(told, ["cls", "a", "v", "y"]).groupBy("__id", "a").agg(F.sum("gain").alias("gain")).groupBy("__id").agg(F.max(F.struct("gain", (-F.col("a")).alias("first"))).alias("b"))
        picks.append(materialize(best.select("__id", F.lit(step).alias("step"), (-F.col("b.first")).alias("pick"), "b.gain")))
        at = F.col("pick") + 1
        refined = F.when(F.substr("cls", at, F.lit(1)) == "1", named(F.col("pick"), F.element_at("vals", at))).otherwise(F.col("cls"))
        asks = asks.join(picks[-1], "__id").select("__id", "y", "vals", (F.col("left") - F.col("gain")).alias("left"), "goal", refined.alias("cls"))
    none = F.array().cast("array<string>")
    if not picks:
        return tuples.select(*attrs, label, "n", none.alias("needed"))
    lists = reduce(DataFrame.unionByName, picks).groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("step", "pick"))).alias("picks"))
    named_attrs = F.transform("picks", lambda x: F.element_at(F.array(*map(F.lit, attrs)), x["pick"] + 1))
    return tuples.join(lists, "__id", "left").select(*attrs, label, "n", F.coalesce(named_attrs, none).alias("needed"))
