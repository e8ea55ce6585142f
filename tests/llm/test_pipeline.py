"""The pipeline stage by stage on the smallest table."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from sparkloom.llm import near_copies

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("id", F.lit("clash"))
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(10**6).cast("long"), "text": F.lit(None).cast("string")}))
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if name != "packed":
            assert docs.columns == columns
            assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
        if name == "language":
            assert docs.filter("text is null").count() == 0
        if name == "near_copies":
            assert docs.groupBy("doc_id").count().filter("count > 1").count() == 0
    assert docs.agg(F.count_distinct("doc_id")).first()[0] > 100


def test_near_copies_drops_edited_copies(spark, monkeypatch):
    """Components over Jaccard >= 0.8 of five-word shingles, by brute force, in one part and in many."""
    rng = random.Random(3)
    word = [f"w{i}" for i in range(500)]
    rows = [(1000 + i, t) for i, t in enumerate(["", None, " \n", "a b", "A  b", "a b c"])]
    for i in range(60):
        words = [rng.choice(word) for _ in range(150)]
        for j in range(5):
            rows.append((i * 5 + j, " ".join(words)))
            for at in rng.sample(range(len(words)), rng.randrange(6)):
                words[at] = rng.choice(word)
    rows += [(3, rows[9][1]), (None, rows[20][1]), (None, "lone text")]

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                a, b = root[x], root[y]
                root = [b if r == a else r for r in root]
    least = {}
    for r, (i, _) in zip(root, rows):
        least[r] = min((v for v in (least.get(r), i) if v is not None), default=None)
    gone = {i for r, (i, _) in zip(root, rows) if least[r] is not None and i != least[r]}
    want = sorted({i for i, _ in rows if i is not None and i not in gone})
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for words in (500_000, 300):
        monkeypatch.setattr(near_copies, "PART_WORDS", words)
        out = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()]
        assert sorted(i for i in out if i is not None) == want and len(want) < 150


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
