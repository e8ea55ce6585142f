from sparkloom.operators import rules
from sparkloom.streaming.score import classify_stream

SF = "/root/testdata/sf0.001"


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    orders.repartition(3).write.parquet(str(tmp_path / "in"))
    book = rules.induce_rules(orders, ["o_orderstatus"], "o_orderpriority", common=True)
    priors = rules.class_priors(orders, "o_orderpriority")
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    classify_stream(stream, book, priors, "o_orderkey", ["o_orderstatus"], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    whole = rules.call(rules.classify(orders, rules.strengths(rules.apply_rules(orders, book, "o_orderkey", ["o_orderstatus"]), "o_orderkey"), priors, "o_orderkey"), "o_orderkey")
    assert {(r.o_orderkey, r.outcome) for r in got.collect()} == {(r.o_orderkey, r.outcome) for r in whole.collect()}
