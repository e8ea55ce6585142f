"""Fuzzy inference over a table. Rules and sets are small and become expressions inside the row.

A rule is (name, {input: set name}, consequent memberships over the sample points).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.columns import membership

Sets = dict[tuple[str, str], tuple[float, float, float]]
Rule = tuple[str, dict[str, str], list[float]]


def _firing(rule: Rule, sets: Sets) -> Column:
    """Least membership of the antecedent; an input that the rule does not use counts as 1."""
    parts = [membership(F.col(c).cast("double"), *sets[c, s]) for c, s in rule[1].items()]
    return F.least(*parts) if len(parts) > 1 else parts[0] if parts else F.lit(1.0)


def firing(df: DataFrame, rules: list[Rule], sets: Sets) -> DataFrame:
    """df with firing: array<struct<rule,strength>>."""
    return df.withColumn("firing", F.array(*(F.struct(F.lit(r[0]).alias("rule"), _firing(r, sets).alias("strength")) for r in rules)))


def infer(df: DataFrame, rules: list[Rule], sets: Sets, implication: str = "minimum") -> DataFrame:
    """df with output: array of memberships over the sample points, clipped or scaled and joined by max."""
    fired = firing(df, rules, sets)
    n = max(len(r[2]) for r in rules)
    at = lambda i: F.col("firing")[i]["strength"]
    imply = (lambda s, y: F.least(s, F.lit(y))) if implication == "minimum" else (lambda s, y: s * y)
    return fired.withColumn("output", F.array(*(F.array_max(F.array(*(imply(at(i), float(r[2][j])) for i, r in enumerate(rules)))) for j in range(n))))


def centre_of_gravity(df: DataFrame, points: list[float], output: str = "output") -> DataFrame:
    """df with cog: sum(y b) / sum(b), 0 where all b are 0."""
    ys = F.array(*(F.lit(float(y)) for y in points))
    total = F.aggregate(output, F.lit(0.0), lambda t, b: t + b)
    moment = F.aggregate(F.zip_with(ys, F.col(output), lambda y, b: y * b), F.lit(0.0), lambda t, b: t + b)
    return df.withColumn("cog", F.when(total > 0, moment / total).otherwise(0.0))


def activation_log(fired: DataFrame, round_col: str) -> DataFrame:
    """round, rule, strength: one row for each."""
    return fired.select(F.col(round_col).alias("round"), F.explode("firing").alias("f")).select("round", "f.rule", "f.strength")


def activation_summary(log: DataFrame) -> DataFrame:
    """rule, activations (non-zero), strongest, first round; rules that never fired have 0 and null."""
    live = F.col("strength") > 0
    return log.groupBy("rule").agg(F.count_if(live).alias("activations"), F.max(F.when(live, F.col("strength"))).alias("strongest"), F.min(F.when(live, F.col("round"))).alias("first_round"))


def holes(log: DataFrame) -> DataFrame:
    return activation_summary(log).filter("activations = 0").select("rule")


def firing_order(log: DataFrame) -> DataFrame:
    return activation_summary(log).filter("activations > 0").select("rule", "first_round").orderBy("first_round", "rule")


def activation_matrix(log: DataFrame, rules: list[str]) -> DataFrame:
    """round and a column per rule."""
    return log.groupBy("round").pivot("rule", rules).agg(F.sum("strength"))


def set_memberships(df: DataFrame, sets: Sets) -> DataFrame:
    return df.withColumns({f"{c}_{s}": membership(F.col(c).cast("double"), *p) for (c, s), p in sets.items()})
