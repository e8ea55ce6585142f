"""What the operators share: tables, materialised steps, size-checked broadcasts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.helpers import drop_steps, materialize, steps_so_far  # noqa: F401

#: id that stands for a null id in orders: after all others
LAST_ID = 2**63 - 1
#: rows and bytes up to which a side of a join is sent to all executors
SMALL_ROWS, SMALL_BYTES = 1_000_000, 32 << 20
#: bytes of queries that are sent to all executors at a time
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_shuffled(df: DataFrame, rows: int, row_bytes: float = 16) -> DataFrame:
    """Hint a broadcast only when the counted rows fit the bound; else the join shuffles."""
    return F.broadcast(df) if rows <= SMALL_ROWS and rows * row_bytes <= SMALL_BYTES else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_batches(asked: DataFrame, key: str, row_bytes: float) -> Iterator[pa.Table]:
    """The rows of a written table of queries, about ``BATCH_BYTES`` at a time, dealt by the hash of their key."""
    n = math.ceil(asked.count() * row_bytes / BATCH_BYTES)
    for i in range(n):
        rows = asked.filter(F.pmod(F.xxhash64(F.col(key), F.lit("batch")), F.lit(n)) == i).toArrow()
        if rows.num_rows:
            yield rows


def rounds(parts: list[DataFrame]) -> DataFrame:
    """All rows of the results of batches; several are written, so that their plans don't add up."""
    if len(parts) == 1:
        return parts[0]
    out = materialize(parts[0])
    for x in parts[1:]:
        out = out.unionByName(materialize(x))
    return out
