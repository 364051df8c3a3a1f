"""Running the batch operators over arriving data, one micro-batch at a time.

Operators are pure functions of a DataFrame, so a stream needs nothing of its own: each batch goes
through the operator and its result is appended with the batch number. Results are additive counts
per batch, so a later sum over batches is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def per_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str,
              checkpoint: str) -> StreamingQuery:
    """Append ``operator(batch)`` to ``out``. A batch repeated after a failure replaces its own
    partition, so nothing is counted twice."""

    def write(batch: DataFrame, number: int) -> None:
        result = operator(batch)
        result.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def check_totals(results: DataFrame) -> DataFrame:
    """Validation results of all batches as one report."""
    return results.groupBy("check", "subject").agg(
        *[F.sum(c).alias(c) for c in ("rows", "passed", "failed", "not_checked")])
