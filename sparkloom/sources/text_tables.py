"""Text tables, matrices and graph files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BARRIER = 1_000_000.0


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (trimmed) and its place: file, start of the file's split, n, which grows with the line within a split."""
    text = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return text.withColumn("n", F.monotonically_increasing_id())


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """placed_lines that are not blank and don't start with #."""
    return placed_lines(spark, path).filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def read_table(spark: SparkSession, path: str, separators: str = "[\\s,:]") -> DataFrame:
    """Names on the first kept line; each column int, else double, else string as a whole. Ragged rows are an error.

    In a folder each file may begin with the names again.
    """
    lines = _lines(spark, path)
    head = lines.orderBy("file", "start", "n").first()
    if head is None:
        raise ValueError(f"{path} has no line")
    rows = lines.withColumn("f", F.split("line", separators, -1))
    names = re.split(separators, head["line"])
    firsts = lines.filter("start = 0").groupBy("file").agg(F.min(F.struct("n", "line")).alias("x")).select("x.*").filter(F.col("line") == head["line"]).select("n")
    # only lines like the first one can be names again
    like = F.col("line") == head["line"]
    body = rows.filter(~like).unionByName(rows.filter(like).join(firsts, "n", "left_anti").select(rows.columns))
    cell = [F.element_at("f", i + 1) for i in range(len(names))]
    kinds = body.agg(
        F.count_if(F.size("f") != len(names)).alias("ragged"), F.count("*").alias("all"),
        *(F.count(F.when(F.size("f") == len(names), c).try_cast(t)).alias(f"{t}_{i}") for i, c in enumerate(cell) for t in ("long", "double")),
    ).first()
    if kinds["ragged"]:
        raise ValueError(f"{kinds['ragged']} rows of {path} don't have {len(names)} fields")
    kind = lambda i: next((t for t in ("long", "double") if kinds[f"{t}_{i}"] == kinds["all"]), "string")
    return body.select(*(c.cast(kind(i)).alias(names[i]) for i, c in enumerate(cell)))


def write_table(df: DataFrame, path: str, sep: str = " ") -> None:
    df.write.csv(path, sep=sep, header=True)


def read_matrix(spark: SparkSession, path: str, sep: str = ",", square: bool = False, barrier: float | None = None) -> DataFrame:
    """i, j, w (0-based); rows of unequal length, or a matrix that should be square and is not, are errors."""
    rows = _lines(spark, path).withColumn("f", F.split("line", sep if sep.strip() else "\\s+", -1))
    # row numbers: the line's rank within its split plus the rows of earlier splits, files in the order of their names
    split = ["file", "start"]
    sizes = rows.groupBy(*split).agg(F.count("*").alias("c"))
    before = sizes.select(*split, F.coalesce(F.sum("c").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = rows.join(F.broadcast(before), split).withColumn("i", (F.col("base") + F.row_number().over(Window.partitionBy(*split).orderBy("n")) - 1).cast("int"))
    shape = numbered.agg(F.count_distinct(F.size("f")).alias("widths"), F.max(F.size("f")).alias("cols"), F.count("*").alias("rows")).first()
    if shape["widths"] > 1 or (square and shape["rows"] and shape["rows"] != shape["cols"]):
        raise ValueError(f"{path} is no {'square ' if square else ''}matrix")
    out = numbered.select("i", F.posexplode("f").alias("j", "w")).select("i", "j", F.col("w").cast("double").alias("w"))
    return out.filter(F.col("w") < barrier) if barrier else out


def adjacency(edges: DataFrame, names: list[str] | None = None) -> DataFrame:
    """x and a column per vertex: the symmetric weight matrix, 0 without an edge."""
    both = edges.select("x", "y", "weight").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"), "weight"))
    names = names or sorted(r[0] for r in both.select("x").distinct().collect())
    return both.groupBy("x").pivot("y", names).agg(F.first("weight")).fillna(0.0)


def write_adjacency(edges: DataFrame, path: str) -> None:
    """The matrix in range-partitioned files, each with the header; in the order of the files, rows are sorted."""
    adjacency(edges).repartitionByRange("x").sortWithinPartitions("x").write.csv(path, header=True)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.parquet(f"{path}/vertices")
    edges.write.parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def graph_matrix(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """row and a column per vertex: vertex values in row 0, the adjacency matrix below."""
    names = sorted(r[0] for r in vertices.select("name").distinct().collect())
    top = vertices.groupBy(F.lit(0).alias("row")).pivot("name", names).agg(F.first("value"))
    number = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i + 1))))
    rest = adjacency(edges, names).select(number[F.col("x")].alias("row"), *names)
    return top.unionByName(rest)


def split_graph_matrix(matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(j, value) and (i, j, w), i and j from 0, of i, j, w rows whose first row holds vertex values."""
    value: Column = F.col("i") == 0
    return matrix.filter(value).select("j", F.col("w").alias("value")), matrix.filter(~value).select((F.col("i") - 1).alias("i"), "j", "w")
