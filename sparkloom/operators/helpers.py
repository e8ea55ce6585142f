"""Steps that several operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: rows up to which a counted side of a join is sent to all executors
SMALL_ROWS = 100_000
#: slices of the random key in which quotas are counted
SLICES = 1 << 16
#: bytes of rows that are sent to all executors at a time
BATCH_BYTES = 16 << 20
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, the warehouse, or a temporary folder in local mode, where the driver is the only machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="spark-") if spark.sparkContext.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/steps"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def step_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = step_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def steps_so_far(spark: SparkSession) -> int:
    return len(_written.get(spark.sparkContext.applicationId, []))


def drop_steps(spark: SparkSession, since: int, until: int) -> None:
    """Delete the tables that this application wrote between two readings of steps_so_far; nothing may read them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.get(spark.sparkContext.applicationId, [])[since:until]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def small_or_shuffled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only when the counted rows fit the bound; else the join shuffles."""
    rows = df.limit(SMALL_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def in_batches(asked: DataFrame, key: str, row_bytes: float) -> Iterator[pa.Table]:
    """The rows of a written table, about ``BATCH_BYTES`` at a time, dealt by the hash of their key."""
    n = math.ceil(asked.count() * row_bytes / BATCH_BYTES)
    for i in range(n):
        rows = asked.filter(F.pmod(F.xxhash64(F.col(key), F.lit("batch")), F.lit(n)) == i).toArrow()
        if rows.num_rows:
            yield rows


def unpivot(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """keys, col, value (string): one row per cell, without nulls dropped."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols)))
    return df.select(*keys, cells.alias("cell")).select(*keys, "cell.col", "cell.value")


def collapse(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct tuples with their number of rows, column n."""
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def distinct_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """The distinct tuples of cols, written, with tuple (a number) and n (their rows): what depends on cols alone is found once for each."""
    return materialize(collapse(df, cols).withColumn("tuple", F.monotonically_increasing_id()))


def global_cumsum(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Running sums over the whole order, named as in values, without a window over one partition.

    Rows are range-partitioned and written with their partition's number; each partition's total is
    an offset for the later ones.  Only one row per partition is summed in one place.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(df.withColumns({f"__{k}": v for k, v in values.items()}).repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("__p").agg(*(F.sum(f"__{k}").alias(f"__s_{k}") for k in values))
    totals = totals.select("__p", *(F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in values))
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(totals), "__p")
    out = out.withColumns({k: F.sum(f"__{k}").over(inside) + F.col(f"__b_{k}") for k in values})
    return out.drop("__p", *(f"__{k}" for k in values), *(f"__b_{k}" for k in values))


def uniform(*key: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) from a row's key: the same on every run and for every partitioning.

    It is the first 13 hexadecimal digits of the MD5 of the key's parts and the seed, joined by |, so that
    any other engine can repeat a draw.  A null part counts as an empty one.
    """
    return (F.conv(F.substring(uniform_digits(*key, seed=seed), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def uniform_digits(*key: Column | str, seed: int = 0) -> Column:
    """The MD5 whose first digits uniform reads."""
    parts = [F.coalesce((k if isinstance(k, Column) else F.col(k)).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))


def uniform_below(share: float, *key: Column | str, seed: int = 0) -> Column:
    """uniform(*key) < share, tested on the digits as text."""
    # d + 0.5 < share * 2^52 for whole d
    whole = math.ceil(share * (1 << 52) - 0.5)
    return F.lit(True) if whole >= 1 << 52 else uniform_digits(*key, seed=seed) < f"{whole:013x}"


def hold_by_hash(df: DataFrame, want: Column, key: list[str], by: str | None = None, seed: int = 0) -> DataFrame:
    """df with held: of each value of by (of all rows, without), the want rows with the smallest random numbers.

    want is an expression over the number of rows n.  The cut is found on a two-level count of the random
    key (``SLICES`` slices), so only the rows of one slice are ranked and no class is sorted as a whole.
    """
    cls = F.col(by) if by else F.lit(0)
    rows = df.withColumn("__u", uniform(*key, seed=seed)).withColumns({"__s": F.floor(F.col("__u") * SLICES), "__c": cls})
    per = rows.groupBy("__c", "__s").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("__c")
    run = F.coalesce(F.sum("n").over(whole.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumns({"before": run, "mine": F.col("n"), "n": F.sum("n").over(whole)}).select(F.col("__c").alias("__d"), F.col("__s").alias("__t"), F.col("before").alias("__before"), F.col("mine").alias("__mine"), want.alias("__want"))
    joined = rows.join(per, F.col("__c").eqNullSafe(F.col("__d")) & (F.col("__s") == F.col("__t")))
    rank = F.row_number().over(Window.partitionBy("__c", "__s").orderBy("__u", *key))
    held = F.when(F.col("__before") + F.col("__mine") <= F.col("__want"), True).when(F.col("__before") >= F.col("__want"), False).otherwise(F.col("__before") + rank <= F.col("__want"))
    return joined.withColumn("held", held).select(*df.columns, "held")
