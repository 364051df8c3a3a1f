"""Tier 7: people who come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.quantiles import percentile
from ..functions.staging import stage
from .periods import trunc_to
from .scope import Scope

PERIODS = ("week", "month", "quarter")


def _entity_days(scope: Scope, entity: str, event: str | None = None) -> DataFrame:
    """``entity, day, events``: a busy entity becomes one row per day, whatever its row count."""
    c = F.col(scope.contract.require_date())
    df = scope.df.where(F.col(entity).isNotNull() & c.isNotNull())
    if event:
        # an event is dated by its earliest row
        df = (df.where(F.col(event).isNotNull()).groupBy(entity, event)
              .agg(F.min(c).cast("date").alias("day")))
    else:
        df = df.select(entity, c.cast("date").alias("day"))
    return df.groupBy(F.col(entity).alias("entity"), "day").agg(F.count("*").alias("events"))


def _check_entity(scope: Scope, entity: str) -> None:
    """Refuse a key that is new on every row, or where nobody has a second date."""
    c = F.col(scope.contract.require_date())
    df = scope.df.where(F.col(entity).isNotNull() & c.isNotNull())
    g = df.groupBy(entity).agg(F.count("*").alias("n"), (F.min(c) != F.max(c)).alias("moved"))
    row = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"),
                F.count_if("moved").alias("moved")).first()
    if row["n"] and row["k"] == row["n"]:
        raise Refused("UNIQUE_ENTITY", f"{entity} is distinct on every row")
    if row["n"] and not row["moved"]:
        raise Refused("NO_SECOND_DATE", f"no {entity} has two different dates")


def cohort_retention(scope: Scope, entity: str, period: str = "month") -> DataFrame:
    """Cohort by offset: people active ``offset`` periods after their first one."""
    if period not in PERIODS:
        raise Refused("BAD_PERIOD", period)
    _check_entity(scope, entity)
    p = trunc_to(period, F.col(scope.contract.require_date()))
    df = scope.df.where(F.col(entity).isNotNull())
    # one row per entity and active period, so a hot entity is as long as the calendar
    active = df.select(F.col(entity).alias("entity"), p.alias("p")).where(
        F.col("p").isNotNull()).distinct()
    first = active.withColumn("cohort", F.min("p").over(Window.partitionBy("entity")))
    months = F.months_between("p", "cohort")
    offset = {"week": F.datediff("p", "cohort") / 7, "month": months, "quarter": months / 3}[period]
    return first.groupBy("cohort", F.round(offset).cast("int").alias("offset")).agg(
        F.count("*").alias("people"))


def unplaced(scope: Scope, entity: str) -> DataFrame:
    """Rows no cohort can hold."""
    c = F.col(scope.contract.require_date())
    e = F.col(entity)
    return scope.df.agg(F.count_if(e.isNull()).alias("no_entity"),
                        F.count_if(e.isNotNull() & c.isNull()).alias("no_date"))


def repeat_behaviour(scope: Scope, entity: str, event: str | None = None) -> DataFrame:
    """People by how often they came, with shares and events."""
    _check_entity(scope, entity)
    days = _entity_days(scope, entity, event)
    per = days.groupBy("entity").agg(F.sum("events").alias("n"))
    n = F.col("n")
    bucket = (F.when(n == 1, "once").when(n == 2, "twice").when(n == 3, "three times")
              .when(n <= 5, "four or five times").otherwise("more than 5 times"))
    out = stage(per.groupBy(bucket.alias("how_often")).agg(F.count("*").alias("people"),
                                                           F.sum("n").alias("events")))
    total = out.agg(F.sum("people")).first()[0]
    return out.select("how_often", "people", (F.col("people") / F.lit(total)).alias("share"),
                      "events")


def repeat_gaps(scope: Scope, entity: str, event: str | None = None) -> DataFrame:
    """Median days from first event to second, and between consecutive events, and repeat rate."""
    days = stage(_entity_days(scope, entity, event))
    w = Window.partitionBy("entity").orderBy("day")
    seq = days.select("entity", "day", "events", F.row_number().over(w).alias("seq"),
                      F.datediff("day", F.lag("day").over(w)).alias("gap"))
    # further events of the same day are that many gaps of zero days
    zeros = F.col("events") - 1
    gaps = seq.groupBy("gap").agg(F.count("gap").alias("n")).where(F.col("gap").isNotNull())
    same = seq.agg(F.sum(zeros).alias("n")).select(F.lit(0).alias("gap"), "n")
    hist = gaps.unionByName(same).groupBy("gap").agg(F.sum("n").alias("n")).where("n > 0")
    consecutive = hist.agg(F.expr("percentile(gap, 0.5, n)").alias("m"))
    first = (seq.groupBy("entity").agg(
        F.sum("events").alias("total"),
        F.max(F.when(F.col("seq") == 1, F.col("events"))).alias("on_first"),
        F.max(F.when(F.col("seq") == 2, F.col("gap"))).alias("second")))
    gap = F.when(F.col("on_first") > 1, F.lit(0)).otherwise(F.col("second"))
    return first.agg(
        F.count("*").alias("people"), F.count_if(F.col("total") > 1).alias("repeaters"),
        (F.count_if(F.col("total") > 1) / F.count("*")).alias("repeat_rate"),
        percentile(gap, 0.5).alias("median_first_gap")).withColumn(
        "median_gap", consecutive.scalar())
