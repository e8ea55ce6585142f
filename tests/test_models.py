"""Models and random operators that SQL cannot express, against plain numpy and Python versions."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import private
from sparkloom.operators import columns, evaluate, matching, release, rules


def draw(*key, seed=0):
    text = "|".join(map(str, [*key, seed]))
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def fit_logistic(x, y, reg=0.0):
    """Newton's method; the first column is the constant, which is penalised too if reg is given."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - y) / len(y) + reg * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + reg * np.eye(len(w)), grad)
    return w


def brute_cindex(score, y):
    won = [1.0 if a > b else 0.5 if a == b else 0.0 for a, p in zip(score, y) if p for b, q in zip(score, y) if not q]
    c = sum(won) / len(won)
    return max(c, 1 - c)


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(11)
    rows = []
    for i in range(240):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, a, b, c, float(rng.random() < 1 / (1 + math.exp(-(1.5 * a - b))))))
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c double, y double").cache()


def test_logistic_cindex_matches_newton(points):
    rows, df = points
    got = evaluate.logistic_cindex(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), ["a", "b"], "y")
    m = np.array(rows)
    x = np.column_stack([np.ones(len(m)), m[:, 1:3]])
    w = fit_logistic(x[::2], m[::2, 4])
    assert got == pytest.approx(brute_cindex(x[1::2] @ w, m[1::2, 4]), abs=2e-3)


def test_variable_selection_finds_the_best_subset(points):
    rows, df = points
    part = [df.filter(f"id % 3 = {k}") for k in range(3)]
    m = np.array(rows)

    def score(mask):
        x = np.column_stack([np.ones(len(m)), *(m[:, 1 + i] for i in range(3) if mask[i])])
        w = fit_logistic(x[::3], m[::3, 4])
        return 0.5 * brute_cindex(x[1::3] @ w, m[1::3, 4]) + 0.5 * (1 - sum(mask) / 3)

    best = max((k for k in itertools.product((0, 1), repeat=3) if any(k)), key=score)
    got = evaluate.select_variables(*part, ["a", "b", "c"], "y", size=8, generations=4)
    assert got["variables"] == [n for n, k in zip("abc", best) if k] and got["score"] == pytest.approx(score(best), abs=2e-3)


def test_cross_validation_scores_every_fold(points):
    rows, df = points
    out = evaluate.cross_validate(df, {"a": lambda train, test: test.withColumn("score", F.col("a")), "b": lambda train, test: test.withColumn("score", F.col("b"))}, lambda t: evaluate.cindex(t, "score", "y").first()["cindex"], 2, ["id"], reps=2)
    for r in out.collect():
        held = [x for x in rows if int(draw(x[0], seed=r.rep) * 2) == r.fold]
        assert r.score == pytest.approx(brute_cindex([x[1 if r.model == "a" else 2] for x in held], [x[4] for x in held]))
    assert out.count() == 8


def test_private_logistic_is_ridge_plus_its_noise(points):
    rows, df = points
    m = np.array(rows)
    x = np.column_stack([np.ones(len(m)), m[:, 1:3]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = fit_logistic(x, m[:, 4], 0.1)
    exact = [r.coefficient for r in release.private_logistic(df, "y", ["a", "b"], 1e12, b"s" * 16).collect()]
    assert exact == pytest.approx(want.tolist(), abs=1e-3)
    # a direction of three normal numbers and a length that is a sum of three exponential ones, all drawn with the secret
    d = lambda *x: private.keyed_draw(private.noise_key(b"s" * 16, "coefficients"), *x)
    b = np.array([math.sqrt(-2 * math.log(d("r", i))) * math.cos(2 * math.pi * d("t", i)) for i in range(3)])
    b *= sum(-math.log(d("e", i)) for i in range(3)) * 2 / (1.0 * len(m) * 0.1) / np.linalg.norm(b)
    noisy = [r.coefficient for r in release.private_logistic(df, "y", ["a", "b"], 1.0, b"s" * 16).collect()]
    assert (np.array(noisy) - np.array(exact)).tolist() == pytest.approx(b.tolist(), abs=1e-6)


def test_spectral_swap_matches_numpy(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aabc"), rng.choice("xy")) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, p string, q string")
    got = {r.id: (r.p, r.q) for r in release.spectral_swap(df, ["p", "q"], "id").collect()}
    wide = np.array([[*(float(p == v) for v in "abc"), float(q == "y")] for _, p, q in rows])
    values, v = np.linalg.eigh(wide.T @ wide)
    v = v[:, values > values.max() * 1e-10]
    scores = wide @ v
    target = {i: n for n, i in enumerate(sorted(range(120), key=lambda i: draw(i)))}
    swapped = np.empty_like(scores)
    for j in range(v.shape[1]):
        source = sorted(range(120), key=lambda i: draw(i, j, seed=1))
        for i in range(120):
            swapped[i, j] = scores[source[target[i]], j]
    back = swapped @ v.T
    clear = [i for i in range(120) if np.diff(np.sort(back[i, :3]))[-1] > 1e-9 and abs(back[i, 3] - 0.5) > 1e-9]
    assert len(clear) > 100
    for i in clear:
        assert got[i] == ("abc"[int(back[i, :3].argmax())], "xy"[int(back[i, 3] > 0.5)])


def brute_weighted_filter(names, outcome, hits, label, weight, bc=10.0):
    """hits: {(point, rule): strength}."""
    signed = {(p, r): s if outcome[r] == label[p] else -s for (p, r), s in hits.items() if s > 0}
    if not signed:
        return set(names)
    top = max(abs(s) for s in signed.values())
    quota = {c: math.ceil(bc * sum(o != c for o in outcome.values())) * top for c in set(outcome.values())}
    open_ = {c for c, q in quota.items() if q > 0}
    left = {p for p in label if sum(s for (q, _), s in signed.items() if q == p) > 0}
    picked = []
    while len(picked) < len(names) and (open_ or left):
        gain = {r: sum(weight[p] * s for (p, q), s in signed.items() if q == r and p in left) + (quota[outcome[r]] if outcome[r] in open_ else 0) for r in names if r not in picked}
        best = max(gain, key=lambda r: (round(gain[r], 9), names[r]))
        if gain[best] < 0:
            break
        picked.append(best)
        open_.discard(outcome[best])
        left = {p for p in left if sum(signed.get((p, r), 0) for r in picked) <= 0}
    return set(picked)


def test_weighted_filter_matches_brute_force(spark):
    rng = random.Random(8)
    for trial in range(3):
        outcome = {r: "xyz"[r % 3] for r in range(9)}
        ante = {r: {f"a{r}": "1"} for r in outcome}
        table = spark.createDataFrame([(r, ante[r], outcome[r]) for r in outcome], "rule_id long, antecedent map<string,string>, outcome string")
        label, weight = {p: rng.choice("xyz") for p in range(25)}, {p: rng.randrange(1, 4) for p in range(25)}
        hits = {(p, r): rng.choice([0.25, 0.5, 1.0]) for p in label for r in outcome if rng.random() < (0.5 if outcome[r] == label[p] else 0.2)}
        scored = spark.createDataFrame([(p, r, outcome[r], s) for (p, r), s in hits.items()], "id long, rule_id long, outcome string, strength double")
        labels = spark.createDataFrame([(p, label[p], weight[p]) for p in label], "id long, y string, n long")
        got = {r.rule_id for r in rules.filter_rules_weighted(table, scored, labels, "id", "y", bc=[10.0, 0.2, 0.05][trial], weight="n").collect()}
        names = {r: f"a{r}=1 => {outcome[r]}" for r in outcome}
        assert got == brute_weighted_filter(names, outcome, hits, label, weight, [10.0, 0.2, 0.05][trial])


def test_fuzzy_classifier_votes_by_its_rules(spark):
    rng = random.Random(9)
    rows = [(i, x := rng.uniform(0, 10), y := rng.uniform(0, 10), "N" if x < 4 else "P" if y < 6 else "Q") for i in range(150)]
    df = spark.createDataFrame(rows, "id long, x double, y double, c string")
    model = rules.fit_fuzzy_classifier(df, ["x", "y"], "c", 3)
    book = [(r.antecedent, r.outcome) for r in model["rules"].collect()]
    sets = {(c, str(k)): (a, t, b) for c, k, a, t, b in model["sets"]}
    rise = lambda x, a, b: 1.0 if a == -math.inf else 0.0 if b == math.inf else min(max((x - a) / (b - a), 0), 1)
    member = lambda x, a, t, b: min(rise(x, a, t), 1 - rise(x, t, b))
    right = 0
    for r in rules.apply_fuzzy_classifier(model, df, "id").collect():
        at = {"x": rows[r.id][1], "y": rows[r.id][2]}
        want = {c: max((min(member(at[k], *sets[k, v]) for k, v in ante.items()) for ante, o in book if o == c), default=0.0) for c in model["classes"]}
        assert {c: r[c] for c in model["classes"]} == pytest.approx(want)
        right += max(want, key=want.get) == rows[r.id][3]
    assert set(model["classes"]) == {"N", "P", "Q"} and right > 90


def test_tree_classifier_on_separable_rows(spark):
    df = spark.createDataFrame([(float(i % 10), float(i // 10), "u" if i % 10 < 3 else "v" if i // 10 < 5 else "w") for i in range(100)], "x double, y double, c string")
    apply, _ = rules.fit_tree_classifier(df, ["x", "y"], "c", 3)
    assert apply(df).filter("predicted <> c").count() == 0


def test_values_are_recovered_from_another_sample(spark):
    """Two halves of one population: frequencies differ, the other columns decide what they leave open."""
    rng = random.Random(10)
    rows = []
    for i in range(3000):
        a = rng.choice("ppppqqr")
        rows.append((i, a, {"p": "s", "q": "t", "r": "u"}[a] if rng.random() < 0.9 else rng.choice("stu"), rng.choice("mmn")))
    whole = spark.createDataFrame(rows, "id long, a string, b string, c string")
    v = whole.filter("id % 2 = 0").select("id", *(F.concat(F.lit("x_"), c).alias(c) for c in "abc"))
    found = matching.recover_values(v, whole.filter("id % 2 = 1"), ["a", "b", "c"], "id", times=3)
    report = matching.mapping_report(found.select(F.lit("all").alias("setting"), F.col("col").alias("run"), (F.col("a") == F.concat(F.lit("x_"), F.col("b"))).alias("right"))).first()
    assert report["mean"] == 1.0 and report["sd"] == 0.0


def test_value_graph_moves_toward_the_mean_score(spark):
    g = spark.createDataFrame([("c", "x", "p", 0.8), ("c", "x", "q", 0.4)], "col string, a string, b string, w double")
    t = spark.createDataFrame([("c", "x", "p", 0.2), ("c", "x", "p", 0.6)], "col string, a string, b string, p double")
    got = {r.b: r.w for r in matching.update_value_graph(g, t, 0.25).collect()}
    assert got == pytest.approx({"p": 0.75 * 0.8 + 0.25 * 0.4, "q": 0.4})


def test_quantiles_match_numpy(spark):
    rng = random.Random(12)
    rows = [(rng.choice([None, rng.gauss(0, 1), float(rng.randrange(4))]), float(rng.randrange(3)), None) for _ in range(500)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    found = columns.quantiles(df, ["x", "y", "z"], [0.0, 0.3, 0.5, 1.0])
    for n, c in enumerate("xy"):
        have = [r[n] for r in rows if r[n] is not None]
        assert found[c][0] == pytest.approx(np.quantile(have, [0.0, 0.3, 0.5, 1.0]).tolist()) and found[c][1] == len(set(have))
    assert found["z"] == ([], 0)
