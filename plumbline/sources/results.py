"""Stored results: written whole with row numbers, read back by page, and checked for staleness."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggs import row_hash_sum
from ..functions.staging import checkpoint_dir, ranked, stage

PREVIEW_ROWS = 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, on storage every executor reaches."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def snapshot(df: DataFrame) -> DataFrame:
    """Row count and order-independent fingerprint."""
    return df.agg(F.count("*").alias("rows"), row_hash_sum(df).alias("fingerprint"))


def write_result(df: DataFrame, path: str, order: list[Column], fmt: str = "parquet") -> DataFrame:
    """The whole result on disk with its row number; returns the first rows of it."""
    numbered = ranked(stage(df), order, "row_no")
    # sorted ranges of row numbers, so a page is found by file statistics
    numbered = numbered.repartitionByRange("row_no").sortWithinPartitions("row_no")
    writer = numbered.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.parquet(path)
    return read_page(df.sparkSession.read.schema(numbered.schema).option("header", "true").format(fmt)
                     .load(path), 1, PREVIEW_ROWS)


def read_page(result: DataFrame, first: int, last: int, columns: list[str] | None = None) -> DataFrame:
    page = result.where(F.col("row_no").between(first, last))
    return page.select("row_no", *columns) if columns else page


def inspect(result: DataFrame, group: tuple[str, str] | None = None, sort: str | None = None,
            descending: bool = False, limit: int = PREVIEW_ROWS, offset: int = 0) -> DataFrame:
    """A stored result filtered to one group, sorted and paged."""
    out = result
    if group:
        column, member = group
        out = out.where(F.col(column).cast("string") == member)
    if sort:
        key = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
        out = out.orderBy(key, *[F.asc_nulls_last(c) for c in out.columns if c != sort])
    return out.offset(offset).limit(limit)


def stale(log: DataFrame, state: DataFrame) -> DataFrame:
    """Stored results whose data, contract or metric has changed since; one row per result."""
    now = state.select("dataset", F.col("fingerprint").alias("__f"), F.col("contract_version").alias("__c"),
                       F.col("metric_version").alias("__m"),
                       *[c for c in state.columns if c not in ("dataset", "fingerprint",
                                                               "contract_version", "metric_version")])
    j = log.join(now, "dataset", "left")

    def moved(a: str, b: str, word: str) -> Column:
        return F.when(~F.col(a).eqNullSafe(F.col(b)), word)

    reason = F.concat_ws(",", moved("fingerprint", "__f", "data"),
                         moved("contract_version", "__c", "contract"),
                         moved("metric_version", "__m", "metric"))
    return j.withColumns({"reason": reason, "stale": reason != ""}).drop("__f", "__c", "__m")


def append_run(spark: SparkSession, path: str, runs: DataFrame) -> None:
    """Add runs to the log: (run_id, kind, dataset, at, detail)."""
    runs.write.mode("append").parquet(path)


def latest_runs(spark: SparkSession, path: str) -> DataFrame:
    """The last run of each kind per dataset; a mergeable maximum instead of a ranking."""
    log = spark.read.parquet(path)
    rest = [c for c in log.columns if c not in ("kind", "dataset")]
    top = F.max(F.struct("at", *[c for c in rest if c != "at"])).alias("r")
    return log.groupBy("kind", "dataset").agg(top).select("kind", "dataset", "r.*")


def run_row(kind: str, dataset: str, detail: str, at: dt.datetime) -> tuple:
    return (uuid.uuid4().hex, kind, dataset, at, detail)
