"""Cutting lineage on shared storage, and distributed running totals.

``stage`` writes an intermediate result once to the reliable checkpoint folder of the session, so
that several later passes read it instead of recomputing the scan below it, and so that it survives
lost executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Refused

#: Up to this many rows, an un-partitioned window is one small sort.
SMALL_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise Refused("NO_CHECKPOINT_DIR",
                      "set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` as it is if it only reads and projects files, which can be read again column by column; else written as such.

    The files lie beside the checkpoints, in the cluster's scratch folder.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    dear = ("Exchange", "Join", "Aggregate", "Window", "Generate", "Python", "Pandas", "Arrow", "ExistingRDD")
    if not any(word in plan for word in dear):
        return df
    path = f"{checkpoint_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a small scan out to every core before work that costs much more than moving it.

    Input that already arrives in at least as many partitions as there are cores, as any large
    table does, is returned as it is; so is anything behind a shuffle.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "AdaptiveSparkPlan" in plan:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def one_row(df: DataFrame):
    """The only row of a global aggregate."""
    return df.first()


def _range_staged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows range-partitioned in ``order``, with the partition number written beside each row.

    The result is checkpointed before it is read twice: range bounds come from a sample, and two
    evaluations could draw different ones.
    """
    spread = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    return stage(spread)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column],
            small_rows: int = SMALL_ROWS) -> DataFrame:
    """Inclusive running sums over the whole frame in ``order``, without one big task.

    ``df`` should already be staged or cheap: it is counted first. ``order`` must be unique for the
    result to be determined. A frame of at most ``small_rows`` rows takes one window; a larger one
    is range-partitioned, summed per partition, and each partition starts from the total of those
    before it (one row per partition, so the offsets stay small).
    """
    measures = {name: expr for name, expr in sums.items()}
    base = df.withColumns({f"__v_{n}": e for n, e in measures.items()})
    drop = [f"__v_{n}" for n in measures]
    if df.count() <= small_rows:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = base.withColumns({n: F.sum(f"__v_{n}").over(w) for n in measures})
        return out.drop(*drop)
    parts = _range_staged(base, order)
    # one row per partition: the window below sorts a few thousand rows at most
    sums_of = parts.groupBy("__part").agg(*[F.sum(f"__v_{n}").alias(f"__o_{n}") for n in measures])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums_of.select("__part", *[
        F.coalesce(F.sum(f"__o_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in measures])
    within = (Window.partitionBy("__part").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = (parts.withColumns({n: F.sum(f"__v_{n}").over(within) for n in measures})
           .join(F.broadcast(offsets), "__part", "left"))
    out = out.withColumns({n: F.col(n) + F.col(f"__o_{n}") for n in measures})
    return out.drop("__part", *drop, *[f"__o_{n}" for n in measures])


def ranked(df: DataFrame, order: list[Column], name: str = "rank",
           small_rows: int = SMALL_ROWS) -> DataFrame:
    """``row_number`` over the whole frame, through the same running total."""
    return running(df, order, {name: F.lit(1).cast("long")}, small_rows)


#: Rows up to which a staged frame of a few numbers per row is broadcast.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (staged: it is counted) with a broadcast hint where it is small; a shuffle join otherwise."""
    return F.broadcast(df) if df.count() <= most else df
