"""Mid-ranks from a value histogram: only (value, group, count) triples are ever ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import running, stage


def midranks(df: DataFrame, value: str, small_rows: int | None = None) -> DataFrame:
    """One row per distinct value: ``value, ties, midrank``."""
    hist = stage(df.where(F.col(value).isNotNull()).groupBy(value)
                 .agg(F.count("*").alias("ties")))
    extra = {} if small_rows is None else {"small_rows": small_rows}
    cum = running(hist, [F.col(value)], {"__upto": F.col("ties")}, **extra)
    return cum.select(value, "ties",
                      (F.col("__upto") - F.col("ties") + (F.col("ties") + 1) / 2).alias("midrank"))


def rank_sums(df: DataFrame, value: str, group: str, small_rows: int | None = None) -> DataFrame:
    """Per group: ``n`` and the sum of mid-ranks taken over all groups together."""
    hist = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    cells = stage(hist.groupBy(value, group).agg(F.count("*").alias("n")))
    per_value = cells.groupBy(value).agg(F.sum("n").alias("ties"))
    extra = {} if small_rows is None else {"small_rows": small_rows}
    cum = running(stage(per_value), [F.col(value)], {"__upto": F.col("ties")}, **extra)
    ranks = cum.select(value, (F.col("__upto") - (F.col("ties") - 1) / 2).alias("midrank"))
    return (cells.join(ranks, value).groupBy(group)
            .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("midrank")).alias("rank_sum")))


def tie_term(df: DataFrame, value: str):
    """Sum of t^3 - t over tied values, and the number of values."""
    hist = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("t"))
    t = F.col("t").cast("double")
    row = hist.agg(F.sum(t * t * t - t).alias("ties"), F.sum("t").alias("n")).first()
    return float(row["ties"] or 0.0), int(row["n"] or 0)
