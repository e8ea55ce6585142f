"""Queries against their SQL on tables made to be awkward for them."""

import sys
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _same(spark, name, sf, *tables):
    """The query's rows are those of its SQL on the tables of sf."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(sf))
    want = con.sql(entry.oracle_sql()[name])
    plain = lambda rows: sorted(tuple(float(v) if isinstance(v, (int, float)) else v for v in r) for r in rows)
    assert plain(got.collect()) == plain(want.select(*map(duckdb.ColumnExpression, got.columns)).fetchall())


def test_frequencies_halfway_between_two_printed_ones(spark, tmp_path):
    part = spark.range(128).select(F.col("id").alias("p_partkey"), F.when(F.col("id") < 1, "one").when(F.col("id") < 4, "three").otherwise("rest").alias("p_brand"), (F.col("id") % 3).cast("int").alias("p_size"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    _same(spark, "g8_g9_vertices", tmp_path, "part")


def test_threshold_on_digits_is_that_on_numbers(spark):
    from sparkloom.operators.helpers import uniform, uniform_below

    drawn = spark.range(400).select("id", uniform("id", seed=3).alias("u")).collect()
    for share in (0.0, 0.37, drawn[7].u, drawn[8].u + 2**-53, 1.0):
        kept = {r.id for r in spark.range(400).filter(uniform_below(share, "id", seed=3)).collect()}
        assert kept == {r.id for r in drawn if r.u < share}


def test_replicates_are_hashed_on_all_tasks(spark, tmp_path):
    """A table in one file is dealt over the shuffle's partitions before its rows are hashed."""
    from sparkloom.operators import assoc

    spark.range(2000).select("id", (F.col("id") % 5).alias("g")).coalesce(1).write.parquet(str(tmp_path / "t"))
    seen = []
    plain = assoc.materialize
    try:
        assoc.materialize = lambda df: (seen.append(df.rdd.getNumPartitions()), plain(df))[1]
        assoc.repeated(spark.read.parquet(str(tmp_path / "t")), lambda s, by: s.groupBy("rep", "g").agg(F.count("*").alias("c")), 3, 50, ["id"], ["g"]).collect()
    finally:
        assoc.materialize = plain
    assert seen[0] == 4


def test_values_are_predicted_once_for_each_tuple(spark, monkeypatch):
    """Means over rows with repeats and nulls are those of plain Python, from predictions of the distinct tuples only."""
    from sparkloom.operators import matching

    rows = [(i, "xy"[i % 2] if i % 11 else None, "pqr"[i % 3]) for i in range(330)] + [(None, "x", "p")]
    w = spark.createDataFrame(rows, "id long, a string, b string")
    v = w.select("id", F.concat(F.lit("v_"), "a").alias("a"), F.concat(F.lit("v_"), "b").alias("b"))
    model = matching.value_model(w, ["a", "b"])
    want = {}
    own = {r.id: r for r in v.collect()}
    for r in matching.predict_values(w, model, ["a", "b"], "id").collect():
        want.setdefault((r.col, own[r.id][r.col], r.b), []).append(r.p)
    plain, seen = matching.predict_values, []
    monkeypatch.setattr(matching, "predict_values", lambda t, *a: (seen.append(t.count()), plain(t, *a))[1])
    got = {(r.col, r.a, r.b): (r.p, r.n) for r in matching.value_triples(v, w, model, ["a", "b"], "id").collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - sum(x) / len(x)) < 1e-9 and got[k][1] == len(x) for k, x in want.items())
    matching.recover_values(v, w, ["a", "b"], "id").collect()
    assert len(seen) == 3 and max(seen) <= 9


def test_cindexes_by_slices_equal_those_of_all_scores(spark, monkeypatch):
    """Ties, held folds, missing features and many slices."""
    from sparkloom.operators import logistic

    df = spark.range(3000).select((F.col("id") * 37 % 101).alias("a"), F.when(F.col("id") % 13 > 0, F.col("id") * 17 % 29).alias("b"), (F.col("id") * 7919 % 10 < 4).cast("int").alias("y"), F.array((F.col("id") % 2).cast("int")).alias("f"))
    rows = logistic.prepared(df, ["a", "b"], "y", "f").repartition(3)
    fits = logistic.fit(rows, [logistic.Model(m, 0, k) for m in ((1, 0), (1, 1)) for k in (0, 1)])
    want = logistic.cindexes(logistic.scored(rows, fits), 4)
    for size in (1 << 21, 100):
        monkeypatch.setattr(logistic, "SLICE", size)
        assert all(abs(a - b) < 1e-12 for a, b in zip(logistic.held_cindexes(rows, fits), want))
