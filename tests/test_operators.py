"""Small cases with known results, and properties of the random operators."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import distributions as T
from sparkloom.operators import assoc, columns, discern, evaluate, fuzzy, helpers, matching, release, rules, sampling
from sparkloom.sources import arff, text_tables


def test_rule_of_the_first_row(spark):
    df = spark.createDataFrame([(0, 1, 2, 0), (1, 1, 3, 1), (2, 2, 2, 1)], "id int, a0 int, a1 int, label int")
    got = {(r.a0, r.a1): r.needed for r in discern.min_attributes_by_row(df, ["a0", "a1"], "label").collect()}
    assert sorted(got[1, 2]) == ["a0", "a1"]
    assert sorted(discern.min_attributes(df, ["a0", "a1"], "label")) == ["a0", "a1"]
    text = [r.rule for r in rules.format_rules(rules.induce_rules(df, ["a0", "a1"], "label")).collect()]
    assert "a0=1 & a1=2 => class=0" in text


def test_missing_values_are_told_from_nothing(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, None, 0), (4, 1, 0), (5, 1, 0)], "e int, c int, d int")
    assert discern.discerned_pairs_missing(df, ["c"]).first()[0] == 4
    rng = random.Random(2)
    rows = [tuple(rng.choice([None, 0, 1, 2]) for _ in range(3)) for _ in range(40)]
    want = sum(any(x is not None and y is not None and x != y for x, y in zip(a, b)) for a, b in itertools.combinations(rows, 2))
    assert discern.discerned_pairs_missing(spark.createDataFrame(rows, "a int, b int, c int"), ["a", "b", "c"]).first()[0] == want


def test_pair_sets_and_counts_agree(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.randrange(3), rng.randrange(2)) for i in range(30)], "id int, a int, b int")
    assert discern.pair_set(df, "id", "a").count() == discern.discerned_pairs(df, ["a"]).first()[0]


def test_covers(spark):
    sets = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 3), (1, 4), (2, 1), (3, 4)], "set_id long, element long")
    assert discern.greedy_cover(sets) == [1, 0]
    assert discern.greedy_cover(sets, tau=0.75) == [1]
    assert discern.greedy_cover(sets, cost={0: 9, 1: 1, 2: 1, 3: 1}) == [1, 2]
    assert discern.min_union(sets, 2) == [2, 0] and discern.min_union(sets, 9) == []


def test_dummies_come_back(spark):
    df = spark.createDataFrame([("a", 1, "2", 3), ("a", 1, "3", 2), ("a", 0, "1", 1)], "c0 string, c1 int, c2 string, c3 int")
    known = columns.domains(df, df.columns)
    wide = columns.dummify(df, df.columns, known)
    assert [sum(c.startswith(x) for c in wide.columns) for x in df.columns] == [1, 1, 3, 3]
    assert sorted(map(tuple, columns.restore(wide, known).select(df.columns).collect())) == sorted(map(tuple, df.collect()))
    drawn = columns.restore(wide, known, "wheel", key=wide.columns)
    assert sorted(map(tuple, drawn.select(df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_membership_variants(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (3.0,), (None,)], "x double")
    at = lambda *a, v: [r[0] for r in df.select(columns.membership(F.col("x"), *a, variant=v)).collect()]
    inf = math.inf
    assert at(0.0, 1.0, 2.0, v="open") == [0.0, 1.0, 0.5, 0.0, None]
    assert at(-inf, 1.0, 2.0, v="step") == [1.0, 1.0, 0.5, 0.0, None]
    assert at(1.0, 2.0, inf, v="step") == [0.0, 0.0, 0.5, 1.0, None]
    assert at(1.0, 1.0, inf, v="step")[1] == 0.0 and at(1.0, 1.0, inf, v="closed")[1] == 1.0
    assert at(0.0, 1.0, 2.0, v="closed")[4] == 1.0 and at(0.0, 1.0, inf, v="closed")[4] == 0.0


def test_order_and_tours(spark):
    v = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 5)], "seq_id int, pos int, value int")
    assert sampling.ascending_score(v, "value").first()["score"] == 4
    dist = spark.createDataFrame([(0, 1, 6.231753), (0, 2, 6.417581), (1, 2, 9.933639), (2, 0, 5.936391), (2, 1, 7.555658), (1, 0, 1e6)], "i int, j int, d double")
    tours = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0), (2, 2, 2)], "seq_id int, pos int, item int")
    got = {r.seq_id: r.length for r in sampling.tour_length(tours, dist).collect()}
    assert got[1] == pytest.approx(22.101783) and got[2] is None


def test_weighted_samples(spark):
    df = spark.createDataFrame([(i, float(1 + i % 5)) for i in range(200)], "id long, w double")
    drawn = sampling.weighted_with_replacement(df, "id", "w", 3000).join(df, "id")
    assert drawn.count() == 3000 and 3.4 < drawn.agg(F.avg("w")).first()[0] < 3.95  # 55 / 15
    assert sampling.systematic(df, "id", "w", 77).agg(F.sum("copies")).first()[0] == 77
    assert sampling.weighted_without_replacement(df, "id", "w", 50).select("id").distinct().count() == 50


def test_running_sums_over_all_rows(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(500)], "id long, v long")
    got = helpers.global_cumsum(df, [F.col("id")], {"run": F.col("v")}).orderBy("id").toPandas()
    assert got["run"].tolist() == np.cumsum([i % 7 for i in range(500)]).tolist()


def test_noisy_counts(spark):
    df = spark.createDataFrame([("a", 80)], "g string, c long")
    eta = df.select(release.calibrate(F.col("c").cast("double"), 1.0, 1, 3, 1, 1, 20, 2000)).first()[0]
    assert eta == pytest.approx(1 / 6)
    means = {}
    for name, p in release.PRESETS.items():
        pmf = release.release_pmf(df, "c", 1.0, bp=p["bp"], bn=p["bn"], rmin=20, rmax=2000)
        assert pmf.select(F.aggregate("pmf", F.lit(0.0), lambda t, x: t + x["p"])).first()[0] == pytest.approx(1)
        means[name] = release.pmf_summary(pmf).first()["mean"]
        assert 20 <= release.draw_release(pmf, ["g"], b"s" * 16).first()["released"] < 2000
    assert means["over"] > means["neutral"] > means["under"]


def test_each_released_row_matches_k_others(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.randrange(4), rng.choice("xyz"), rng.choice([None, 1, 2])) for i in range(80)], "id long, a int, b string, c int")
    attrs = ["a", "b", "c"]
    out = release.kambiguate(df, attrs, 5)
    assert out.count() == 80
    original = df.collect()
    for r in out.collect():
        gone = set(r.suppressed)
        assert sum(all(x in gone or r[x] == o[x] for x in attrs) for o in original) >= 6
    assert all(set(r.suppressed) == set(attrs) for r in release.kambiguate(df.limit(4), attrs, 5).collect())
    counts = release.match_count(out.select(*attrs), df.select(*attrs), attrs)
    assert counts.agg(F.sum("n")).first()[0] == 80


def test_spectral_swap_keeps_marginals_roughly(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.choice("aab"), rng.choice("xy")) for i in range(150)], "id long, p string, q string")
    out = release.spectral_swap(df, ["p", "q"], "id")
    assert out.count() == 150 and {r.p for r in out.collect()} <= {"a", "b"}


def test_histogram_and_jitter(spark):
    df = spark.createDataFrame([(i % 3, "u" if i % 2 else "v", "t" if i % 3 else "s") for i in range(600)], "a int, b string, t string")
    hist = release.projected_histogram(df, ["a", "b"], "t", 5.0, b"s" * 16, 600, {"a": (0, 2)}, {"b": ["u", "v"], "t": ["s", "t"]}, k=1)
    assert hist.filter("count < 0").count() == 0 and abs(release.expand(hist).count() - 600) < 60
    x = spark.createDataFrame([(i, float(i % 4)) for i in range(100)], "id long, x double")
    got = release.jitter(x, "x", 0.5, ["id"], b"s" * 16, release.smallest_gap(x, "x")).toPandas()
    assert (np.abs(got["x"] - got["id"] % 4) <= 0.1).all()


def test_lander_first_step(spark):
    inf = math.inf
    sets = {("distance", "veryfar"): (5000.0, 10000.0, inf), ("distance", "far"): (1000.0, 5000.0, 10000.0), ("velocity", "reallyfast"): (200.0, 300.0, inf), ("velocity", "fast"): (100.0, 200.0, 300.0)}
    book = [("r1", {"distance": "veryfar", "velocity": "reallyfast"}, [0.0, 0.5, 1.0, 0.5, 0.0, 0.0]), ("r2", {"distance": "far", "velocity": "fast"}, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(1, 10000.0, 300.0)], "round int, distance double, velocity double")
    out = fuzzy.centre_of_gravity(fuzzy.infer(df, book, sets), [1, 2, 3, 4, 5, 6])
    row = out.first()
    assert [f["strength"] for f in row.firing] == [1.0, 0.0] and row.cog == pytest.approx(3.0)
    log = fuzzy.activation_log(out, "round")
    assert [r.rule for r in fuzzy.holes(log).collect()] == ["r2"] and [r.rule for r in fuzzy.firing_order(log).collect()] == ["r1"]


def test_rule_application_and_fallbacks(spark):
    r = spark.createDataFrame([(1, {"a": "1", "b": "x"}, "p"), (2, {"b": "y"}, "q"), (3, {"a": "1"}, "p")], "rule_id long, antecedent map<string,string>, outcome string")
    pts = spark.createDataFrame([(1, "1", "x"), (2, "1", "z"), (3, "0", "x"), (4, None, "w")], "id long, a string, b string")
    s = rules.strengths(rules.apply_rules(pts, r, "id", ["a", "b"]), "id")
    priors = spark.createDataFrame([("p", 0.75), ("q", 0.25)], "outcome string, prior double")
    got = {(x.id, x.outcome): x.strength for x in rules.classify(pts, s, priors, "id", normal=False).collect()}
    assert got == {(1, "p"): 2.0, (2, "p"): 1.0, (3, "p"): 0.5, (4, "p"): 0.75, (4, "q"): 0.25}
    called = {x.id: x.outcome for x in rules.call(rules.classify(pts, s, priors, "id"), "id").collect()}
    assert called == {1: "p", 2: "p", 3: "p", 4: "p"}


def test_stratified_split_is_exact(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(301)], "id long, c string")
    got = {r.c: (r.n, r.h) for r in rules.stratified_split(df, "c", ["id"], 0.3).groupBy("c").agg(F.count("*").alias("n"), F.sum(F.col("held").cast("int")).alias("h")).collect()}
    assert got == {c: (n, math.floor(0.3 * n)) for c, n in (("a", 200), ("b", 101))}


def test_phi_of_a_known_table(spark):
    df = spark.createDataFrame([("a", "x")] * 30 + [("a", "y")] * 10 + [("b", "x")] * 5 + [("b", "y")] * 25, "p string, q string")
    row = assoc.measures(assoc.pair_counts(df, ["p", "q"])).first()
    chi2 = 70 * (30 * 25 - 10 * 5) ** 2 / (40 * 30 * 35 * 35)
    assert row.chi2 == pytest.approx(chi2) and row.phi == pytest.approx(math.sqrt(chi2 / 70)) and row.v == pytest.approx(row.phi)


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = int(rng.integers(1, 6)), 0
        m = n + int(rng.integers(0, 3))
        cost = rng.random((n, m)).round(2)
        got = matching.assignment(cost)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert len(set(got)) == n and cost[np.arange(n), got].sum() == pytest.approx(best)


def test_color_coding_finds_the_exact_matching(spark):
    rng = random.Random(6)
    names = [f"v{i}" for i in range(6)]
    v = spark.createDataFrame([(n, rng.random()) for n in names], "name string, value double").cache()
    e = spark.createDataFrame([(a, b, rng.random()) for a, b in itertools.combinations(names, 2)], "x string, y string, weight double").cache()
    tree = [("v0", -1), ("v1", 0), ("v2", 0)]
    sim = matching.vertex_similarity(v, v)
    a, b = matching.match_exact(tree, e, e, sim).collect(), matching.match_colored(tree, e, e, sim, eps=0.01).collect()
    assert [r.path for r in a] == [["v0", "v1", "v2"]] and {tuple(r.path) for r in b} == {("v0", "v1", "v2")}
    assert a[0].score == pytest.approx(5.0) and b[0].score == pytest.approx(5.0)


def test_distributions_against_known_values(spark):
    assert T.norm_cdf(np.array([0.0, 1.959963985]))[1] == pytest.approx(0.975)
    assert T.beta_cdf(np.array([0.3]), 2.0, 3.0)[0] == pytest.approx(0.3483)
    assert T.gamma_cdf(np.array([1.0, 9.0]), np.array([1.0, 4.0]))[0] == pytest.approx(1 - math.exp(-1))
    assert T.gamma_cdf(np.array([9.0]), np.array([4.0]))[0] == pytest.approx(1 - math.exp(-9) * (1 + 9 + 40.5 + 121.5))
    assert T.t_cdf(np.array([2.228138852]), 10.0)[0] == pytest.approx(0.975)
    df = spark.createDataFrame([(0.975,), (None,)], "p double")
    got = [r[0] for r in df.select(T.quantile(F.col("p"), T.norm_cdf, -10, 10)).collect()]
    assert got[0] == pytest.approx(1.959963985) and got[1] is None


def test_cindex_and_hanley(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(20), int(rng.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "p int, y int")
    won = [1.0 if a > b else 0.5 if a == b else 0.0 for a, y in rows if y for b, z in rows if not z]
    c = sum(won) / len(won)
    assert evaluate.cindex(df, "p", "y").first()["cindex"] == pytest.approx(max(c, 1 - c))
    assert evaluate.cindex(df.filter("y = 1"), "p", "y").first()["cindex"] is None
    assert evaluate.hanley_r(0.5, 0.7) == pytest.approx(0.47, abs=0.02) and evaluate.hanley_r(0.9, 0.975) == pytest.approx(0.82, abs=0.02)
    assert evaluate.hanley_r(0.5, 0.6) is None


ARFF = """% a comment
@relation sparse
@attribute a1 string
@attribute a2 string
@attribute a3 {val1,val2,val3}
@attribute a4 string
@attribute a6 numeric
@data
{1 X,3 Y,4 7.5}
{2 val2,3 'class B, too'}
"""


def test_arff_sparse_and_back(spark, tmp_path):
    (tmp_path / "a.arff").write_text(ARFF)
    name, sparse, schema, df = arff.read_arff(spark, str(tmp_path / "a.arff"))
    assert (name, sparse, schema["a3"].metadata["levels"]) == ("sparse", True, ["val1", "val2", "val3"])
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([(None, "X", "val1", "Y", 7.5), (None, None, "val2", "class B, too", 0.0)], key=repr)
    typed = spark.createDataFrame(df.rdd, schema)
    arff.write_arff(typed, str(tmp_path / "dense"), "my table")
    back = arff.read_arff(spark, str(tmp_path / "dense"))
    assert back[0] == "my table" and not back[1] and sorted(map(tuple, back[3].collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_text_tables_and_matrices(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# note\nname size:price\n\na 1 2.5\nb,2,3\n")
    df = text_tables.read_table(spark, str(tmp_path / "t.txt"))
    assert [t for _, t in df.dtypes] == ["string", "bigint", "double"] and df.count() == 2
    (tmp_path / "bad.txt").write_text("a b\n1 2 3\n")
    with pytest.raises(ValueError):
        text_tables.read_table(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "m.txt").write_text("0 1 1000000\n2 0 3\n4 5 0\n")
    m = text_tables.read_matrix(spark, str(tmp_path / "m.txt"), " ", square=True, barrier=text_tables.BARRIER)
    assert {(r.i, r.j): r.w for r in m.collect()} == {(0, 0): 0, (0, 1): 1, (1, 0): 2, (1, 1): 0, (1, 2): 3, (2, 0): 4, (2, 1): 5, (2, 2): 0}


def test_cross_validation_uses_every_row_once(spark):
    df = spark.createDataFrame(pd.DataFrame({"id": range(50), "y": [i % 2 for i in range(50)]}))
    seen = []
    evaluate.cross_validate(df, {"m": lambda a, b: (seen.append((a.count(), b.count())), b)[1]}, lambda t: 1.0, 2, ["id"], reps=2)
    assert len(seen) == 4 and all(a + b == 50 for a, b in seen)
