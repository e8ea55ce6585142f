"""Sketches of a stream's columns, one increment for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators import sketches


def sketch_stream(rows: DataFrame, cols: list[str], out: str, checkpoint: str, error: float = 0.01, by: list[str] | None = None) -> StreamingQuery:
    """Add the sketches of each arriving micro-batch to the folder out, where sketches.stored reads them.

    A repeated micro-batch after a failure replaces its own increment, so each row counts once.
    """

    def step(batch: DataFrame, number: int) -> None:
        sketches.add_increment(batch, cols, out, number, error, by)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
