"""Rules (antecedent attribute -> value, outcome): induction, application, classification, filtering.

A rules table has rule_id long, antecedent map<string,string>, outcome string.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import columns, discern
from sparkloom.operators.helpers import SMALL_ROWS, collapse, hold_by_hash, materialize, small_or_shuffled, unpivot


def class_priors(df: DataFrame, label: str) -> DataFrame:
    """outcome, prior."""
    n = df.groupBy(F.col(label).alias("outcome")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 1
    return n.select("outcome", (F.col("n") / total).alias("prior"))


def default_class(df: DataFrame, label: str) -> str | None:
    row = df.groupBy(label).count().orderBy(F.desc("count"), label).first()
    return row[label] if row else None


def stratified_split(df: DataFrame, label: str, key: list[str], p: float = 0.3, seed: int = 0) -> DataFrame:
    """df with held: floor(p * n) rows of each class are True."""
    return hold_by_hash(df, F.floor(F.lit(p) * F.col("n")), key, label, seed)


def induce_rules(df: DataFrame, attrs: list[str], label: str, tau: float = 1.0, common: bool = False) -> DataFrame:
    """One rule for each distinct tuple from its own attribute list, or from one list for all; repeated rules once."""
    if common:
        picked = discern.min_attributes(df, attrs, label, tau)
        rows = df.filter(F.col(label).isNotNull()).select(*attrs, label).distinct().withColumn("needed", F.array(*map(F.lit, picked)))
    else:
        rows = discern.min_attributes_by_row(df, attrs, label, tau)
    whole = F.map_from_arrays(F.array(*map(F.lit, attrs)), F.array(*(F.col(a).cast("string") for a in attrs)))
    ante = F.map_filter(whole, lambda k, v: F.array_contains("needed", k) & v.isNotNull())
    return distinct_rules(rows.select(ante.alias("antecedent"), F.col(label).cast("string").alias("outcome")).filter(F.size("antecedent") > 0))


def _text(ante: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(ante)), lambda e: F.concat_ws("=", e["key"], e["value"])), " & ")


def distinct_rules(rules: DataFrame) -> DataFrame:
    """Each (antecedent, outcome) once, rule_id by hash of its text."""
    t = rules.withColumn("__t", F.concat_ws(" => ", _text(F.col("antecedent")), "outcome")).dropDuplicates(["__t"])
    return t.select(F.xxhash64("__t").alias("rule_id"), "antecedent", "outcome")


#: copies of a proposition when there are too many to be sent to all executors
_SALT = 16


def _meet(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """cells (col, value, ...) with the propositions of rules that hold.

    Few values mean hot keys, so propositions are sent to all executors while they are counted few; more
    of them are copied ``_SALT`` times and cells dealt over the copies.
    """
    props = rules.select("rule_id", "outcome", F.size("antecedent").alias("size"), F.explode("antecedent").alias("col", "value"))
    if props.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return cells.join(F.broadcast(props), ["col", "value"])
    copies = props.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))))
    dealt = cells.withColumn("salt", F.pmod(F.xxhash64(*cells.columns), F.lit(_SALT)).cast("int"))
    return dealt.join(copies, ["col", "value", "salt"]).drop("salt")


def apply_rules(df: DataFrame, rules: DataFrame, key: str, attrs: list[str]) -> DataFrame:
    """key, rule_id, outcome, matched, size: pairs with at least one proposition that holds.

    Points and propositions meet in an equi-join on (attribute, value), never all with all.
    """
    cells = unpivot(df, [key], attrs).filter("value is not null")
    return _meet(cells, rules).groupBy(key, "rule_id", "outcome", "size").agg(F.count("*").alias("matched"))


def strengths(applied: DataFrame, key: str) -> DataFrame:
    """key, rule_id, outcome, strength (1 if all propositions hold) and partial (1 / (1 + m^2), m unmatched)."""
    m = F.col("size") - F.col("matched")
    return applied.select(key, "rule_id", "outcome", (m == 0).cast("double").alias("strength"), (1 / (1 + m * m)).alias("partial"))


def fuzzy_strengths(df: DataFrame, rules: DataFrame, key: str, sets: list[tuple[str, int, float, float, float]]) -> DataFrame:
    """key, rule_id, outcome, strength > 0: min over the antecedent of memberships in the named levels.

    Memberships become rows (column, level, value), which meet the propositions in an equi-join; a
    proposition without a row has strength 0, so an incomplete antecedent has none.
    """
    cells = [F.struct(F.lit(c).alias("col"), F.lit(str(r)).alias("value"), columns.membership(F.col(c).cast("double"), a, t, b, variant="open").alias("m")) for c, r, a, t, b in sets]
    rows = df.select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.*").filter("m > 0")
    hit = _meet(rows, rules).groupBy(key, "rule_id", "outcome", "size").agg(F.count("*").alias("n"), F.min("m").alias("strength"))
    return hit.filter("n = size").select(key, "rule_id", "outcome", "strength")


def classify(points: DataFrame, scored: DataFrame, priors: DataFrame, key: str, combine: str = "sum", normal: bool = True) -> DataFrame:
    """key, outcome, strength for each point: full matches, else partial ones, else the priors."""
    f = F.sum if combine == "sum" else F.max
    per = scored.groupBy(key, "outcome").agg(f("strength").alias("full"), f("partial").alias("part"))
    w = Window.partitionBy(key)
    per = per.withColumn("strength", F.when(F.max("full").over(w) > 0, F.col("full")).otherwise(F.col("part")))
    per = per.filter("strength > 0").select(key, "outcome", "strength")
    rest = points.select(key).join(per.select(key).distinct(), key, "left_anti")
    known = priors.agg(F.collect_list(F.struct("outcome", F.col("prior").alias("strength")))).first()[0]
    base = F.array(*(F.struct(F.lit(r["outcome"]).alias("outcome"), F.lit(r["strength"]).alias("strength")) for r in known))
    out = per.unionByName(rest.select(key, F.explode(base).alias("x")).select(key, "x.*"))
    return out.withColumn("strength", F.col("strength") / F.sum("strength").over(w)) if normal else out


def of_rows(df: DataFrame, points: DataFrame, found: DataFrame, key: str, attrs: list[str]) -> DataFrame:
    """found (tuple, ...), made for the distinct tuples of attrs (helpers.distinct_rows), for each row of df by its key.

    Rules see nothing of a row but its attributes, so equal rows are applied, classified and called once.
    """
    held = points.select("tuple", *(F.col(a).alias(f"__{a}") for a in attrs))
    same = F.lit(True)
    for a in attrs:
        same = same & F.col(a).eqNullSafe(F.col(f"__{a}"))
    all_ = materialize(found.join(held, "tuple"))
    return df.select(key, *attrs).join(small_or_shuffled(all_), same).drop("tuple", *attrs, *(f"__{a}" for a in attrs))


def call(pred: DataFrame, key: str) -> DataFrame:
    """key, outcome (largest strength, then largest label) and last: strength of the last class of the label order."""
    last = pred.agg(F.max("outcome")).first()[0]
    return pred.groupBy(key).agg(F.max(F.struct("strength", "outcome"))["outcome"].alias("outcome"), F.coalesce(F.max(F.when(F.col("outcome") == last, F.col("strength"))), F.lit(0.0)).alias("last"))


def vote(points: DataFrame, scored: DataFrame, key: str, classes: list[str]) -> DataFrame:
    """key and a column per class: the largest strength of its rules, 0 without."""
    wide = scored.groupBy(key).pivot("outcome", classes).agg(F.max("strength"))
    return points.select(key).join(wide, key, "left").fillna(0.0, classes)


def _named(rules: DataFrame) -> DataFrame:
    """rule_id, outcome and name: the rule's text, which orders rules the same way everywhere."""
    return materialize(rules.select("rule_id", "outcome", F.concat_ws(" => ", _text(F.col("antecedent")), "outcome").alias("name")))


def _only(rules: DataFrame, names: DataFrame, picked: list[str]) -> DataFrame:
    kept = names.join(F.broadcast(names.sparkSession.createDataFrame([(x,) for x in picked], "name string")), "name").select("rule_id")
    return rules.join(F.broadcast(kept), "rule_id", "left_semi")


def filter_rules(rules: DataFrame, scored: DataFrame, labels: DataFrame, key: str, label: str, tau: float = 1.0, cover: float = 1.0) -> DataFrame:
    """Rules of a greedy cover of the points they classify rightly with strength tau; all if none does."""
    right = scored.join(labels.select(key, F.col(label).cast("string").alias("outcome")), [key, "outcome"]).filter(F.col("strength") >= tau)
    names = _named(rules)
    picked = discern.greedy_cover(right.join(small_or_shuffled(names.select("rule_id", F.col("name").alias("set_id"))), "rule_id").select("set_id", F.col(key).alias("element")), cover)
    return _only(rules, names, picked) if picked else rules


def filter_rules_weighted(rules: DataFrame, scored: DataFrame, labels: DataFrame, key: str, label: str, bc: float = 10.0, weight: str | None = None) -> DataFrame:
    """Rules of a greedy cover by signed strengths, with a quota for each class.

    A rule counts for the points of its class with its strength, against other points with the negative.  Points
    with a sum over 0 are to be covered: they are once the picked rules' sum is over 0.  Each class has one more point,
    on which its rules have ceil(bc * number of other classes' rules) * (largest strength).  The rule with the largest
    sum over what is left is picked, the last by text on ties, as long as that is not negative.  weight: a column
    of labels, how many points a row stands for.  All rules stay if there is nothing to cover.

    Points are collapsed to their lists of (rule, signed strength) first; each round is one aggregate over these.
    """
    spark, names = rules.sparkSession, _named(rules)
    known = labels.select(key, F.col(label).cast("string").alias("y"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("__n"))
    signed = scored.filter("strength > 0").join(known, key).withColumn("s", F.when(F.col("outcome") == F.col("y"), F.col("strength")).otherwise(-F.col("strength")))
    lists = signed.join(small_or_shuffled(names.select("rule_id", "name")), "rule_id").groupBy(key, "__n").agg(F.sort_array(F.collect_list(F.struct("name", "s"))).alias("hits"), F.sum("s").alias("all"))
    points = materialize(lists.groupBy("hits").agg(F.sum("__n").alias("n"), F.first("all").alias("all")).withColumn("sum", F.lit(0.0)))
    top = points.agg(F.max(F.array_max(F.transform("hits", lambda h: F.abs(h["s"]))))).first()[0]
    if top is None:
        return rules
    points = points.filter("all > 0").drop("all")
    sizes = {r["outcome"]: r["n"] for r in names.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    quota = {c: math.ceil(bc * (total - n)) * top for c, n in sizes.items()}
    picked: list[str] = []
    open_ = {c for c, q in quota.items() if q > 0}
    while len(picked) < total:
        if not open_ and points.limit(1).count() == 0:
            break
        gain = points.select("n", F.explode("hits").alias("h")).groupBy("h.name").agg(F.sum(F.col("n") * F.col("h.s")).alias("gain"))
        bonus = spark.createDataFrame([(c, float(quota[c])) for c in sorted(open_)], "outcome string, bonus double")
        left = names.join(F.broadcast(spark.createDataFrame([(x,) for x in picked], "name string")), "name", "left_anti")
        each = left.join(gain, "name", "left").join(F.broadcast(bonus), "outcome", "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0)))
        best = each.filter("gain >= 0").orderBy(F.desc("gain"), F.desc("name")).first()
        if best is None:
            break
        picked.append(best["name"])
        open_.discard(best["outcome"])
        mine = F.aggregate("hits", F.lit(0.0), lambda t, h: t + F.when(h["name"] == best["name"], h["s"]).otherwise(0.0))
        points = points.withColumn("sum", F.col("sum") + mine).filter("sum <= 0")
        if len(picked) % 8 == 0:
            points = materialize(points)
    return _only(rules, names, picked)


def format_rules(rules: DataFrame, label: str = "class") -> DataFrame:
    """outcome, rule: text such as "a=1 & b=2 => class=c", falling within each class."""
    t = F.concat(_text(F.col("antecedent")), F.lit(f" => {label}="), F.col("outcome"))
    return rules.select("outcome", t.alias("rule")).orderBy("outcome", F.desc("rule"))


def fit_fuzzy_classifier(df: DataFrame, attrs: list[str], label: str, levels: int = 3) -> dict:
    """rules, sets (membership table), unfiltered rules: quantile levels, rules by row, weighted filter."""
    cuts = columns.cuts_between_quantiles(df, attrs, levels)
    wide = [a for a in attrs if cuts[a]]
    coarse = df.select(*(columns.level(F.col(a), cuts[a]).alias(a) for a in wide), label)
    rules = materialize(induce_rules(coarse, wide, label, 0.95))
    sets = columns.membership_table(df, wide, levels)
    # equal rows are one point with their number as weight
    points = materialize(collapse(df, [*wide, label]).withColumn("__key", F.to_json(F.struct(*wide, label))))
    scored = materialize(fuzzy_strengths(points, rules, "__key", sets))
    return {"rules": filter_rules_weighted(rules, scored, points, "__key", label, weight="n"), "sets": sets, "unfiltered": rules, "classes": sorted(r[0] for r in rules.select("outcome").distinct().collect())}


def apply_fuzzy_classifier(model: dict, df: DataFrame, key: str) -> DataFrame:
    return vote(df, fuzzy_strengths(df, model["rules"], key, model["sets"]), key, model["classes"])


def fit_tree_classifier(df: DataFrame, attrs: list[str], label: str, depth: int = 5):
    """(function table -> table with column predicted, model): a decision tree over numeric attributes."""
    names = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(df)
    whole = VectorAssembler(inputCols=attrs, outputCol="__x", handleInvalid="skip")
    model = DecisionTreeClassifier(featuresCol="__x", labelCol="__y", maxDepth=depth, seed=1).fit(whole.transform(names.transform(df)))
    labels = F.array(*map(F.lit, names.labels))
    return lambda t: model.transform(whole.transform(t)).withColumn("predicted", F.element_at(labels, F.col("prediction").cast("int") + 1)).drop("__x", "rawPrediction", "probability", "prediction"), model
