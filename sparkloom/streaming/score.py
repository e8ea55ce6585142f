"""Rule classification of a stream of points. Rules and priors are tables; each micro-batch is classified on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators import rules


def classify_stream(points: DataFrame, book: DataFrame, priors: DataFrame, key: str, attrs: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Write key, outcome, last of each arriving point to parquet under ``out``, one folder per micro-batch.

    A repeated micro-batch after a failure overwrites its own folder, so each point is written once.
    """

    def step(batch: DataFrame, number: int) -> None:
        scored = rules.strengths(rules.apply_rules(batch, book, key, attrs), key)
        called = rules.call(rules.classify(batch, scored, priors, key), key)
        called.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return points.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
