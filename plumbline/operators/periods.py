"""The calendar: a generated spine of periods that holds rows or says it does not."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.aggs import declared
from ..functions.quantiles import grouped

GRAINS = ("day", "week", "month", "quarter", "year")
STEP = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH",
        "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}


def checked_grain(grain: str) -> str:
    g = str(grain).strip().lower()
    if g not in GRAINS:
        raise Refused("BAD_GRAIN", f"{grain!r} is not one of {', '.join(GRAINS)}")
    return g


def trunc_to(grain: str, c: Column) -> Column:
    """First day of the period, as a DATE."""
    d = c.cast("date")
    return d if checked_grain(grain) == "day" else F.trunc(d, grain)


def label_start(label, grain: str) -> dt.date:
    """'2024-05', '2024-Q2', '2024', '2024-05-07' or a date -> the period's first day."""
    g = checked_grain(grain)
    if isinstance(label, dt.date):
        day = label
    else:
        try:
            if g == "year":
                day = dt.date(int(label), 1, 1)
            elif g == "quarter":
                day = dt.date(int(label[:4]), 3 * int(label[-1]) - 2, 1)
            elif g == "month":
                day = dt.date(int(label[:4]), int(label[5:7]), 1)
            else:
                day = dt.date.fromisoformat(label)
        except ValueError:
            raise Refused("UNKNOWN_PERIOD", f"{label!r} is not a {g}") from None
    if g == "year":
        return day.replace(month=1, day=1)
    if g == "quarter":
        return day.replace(month=3 * ((day.month - 1) // 3) + 1, day=1)
    if g == "month":
        return day.replace(day=1)
    if g == "week":
        return day - dt.timedelta(days=day.weekday())
    return day


def bounds(scope):
    """First and last day of the calendar: the declared window, else the observed span."""
    w = scope.contract.window
    if w:
        return w.start, w.end
    c = F.col(scope.contract.require_date()).cast("date")
    row = scope.df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
    if row["lo"] is None:
        raise Refused("NO_DATES", "no row in scope is dated")
    return row["lo"], row["hi"]


def spine_array(lo: dt.date, hi: dt.date, grain: str) -> Column:
    """Every period start between two days; its length is a property of the calendar."""
    g = checked_grain(grain)
    return F.sequence(F.lit(label_start(lo, g)), F.lit(label_start(hi, g)), F.expr(STEP[g]))


def spine(spark, lo: dt.date, hi: dt.date, grain: str) -> DataFrame:
    return spark.range(1).select(F.explode(spine_array(lo, hi, grain)).alias("period"))


def per_period(scope, aggs: list[Column], grain: str, keys: list[str] = ()) -> DataFrame:
    """Aggregates per period that holds rows (and per member of ``keys``)."""
    c = scope.contract.require_date()
    dated = scope.df.where(F.col(c).isNotNull())
    return dated.groupBy(trunc_to(grain, F.col(c)).alias("period"), *keys).agg(*aggs)


def measured_per_period(scope, measure: str, grain: str, keys: list[str] = ()) -> DataFrame:
    """``period, [keys], value, rows`` with the measure's declared aggregate."""
    m = scope.contract.measure(measure)
    if m.agg != "median":
        return per_period(scope, [declared(m).alias("value"), F.count("*").alias("rows")],
                          grain, keys)
    c = scope.contract.require_date()
    dated = scope.df.where(F.col(c).isNotNull()).select(trunc_to(grain, F.col(c)).alias("period"),
                                                        *keys, measure)
    return grouped(dated, ["period", *keys], [F.count("*").alias("rows")], {"value": (measure, 0.5)})


def on_calendar(scope, frame: DataFrame, grain: str) -> DataFrame:
    """``frame`` hung on the full spine: an absent period keeps NULL values and 0 rows."""
    lo, hi = bounds(scope)
    days = spine(scope.df.sparkSession, lo, hi, grain)
    out = days.join(frame, "period", "left")
    return out.withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))


def islands(frame: DataFrame, position: Column, flag: Column, by: list[str] = ()) -> DataFrame:
    """Runs of consecutive ``position`` numbers where ``flag`` holds: ``first, length``."""
    hit = frame.where(flag).select(*by, position.alias("pos"))
    w = Window.partitionBy(*by, F.lit(0)).orderBy("pos")
    runs = hit.withColumn("grp", F.col("pos") - F.row_number().over(w))
    return runs.groupBy(*by, "grp").agg(F.min("pos").alias("first"), F.count("*").alias("length"))


def numbered(spined: DataFrame) -> DataFrame:
    """Spine position; the window is as long as the calendar, never as long as the table."""
    return spined.withColumn("pos", F.row_number().over(Window.orderBy("period")))


def longest_gap(scope, grain: str) -> DataFrame:
    """One row: periods, present, missing, longest unbroken run of empty periods."""
    cal = numbered(on_calendar(scope, per_period(scope, [F.count("*").alias("rows")], grain), grain))
    runs = islands(cal, F.col("pos"), F.col("rows") == 0)
    longest = runs.agg(F.coalesce(F.max("length"), F.lit(0)).cast("long").alias("longest_gap"))
    counts = cal.agg(F.count("*").alias("periods"), F.count_if(F.col("rows") > 0).alias("present"),
                     F.count_if(F.col("rows") == 0).alias("missing"))
    return counts.withColumn("longest_gap", longest.scalar())


def edges(scope, grain: str = "month") -> DataFrame:
    """One row: bounds, observed span, undated rows and what the edges look like."""
    c = F.col(scope.contract.require_date())
    d = c.cast("date")
    w = scope.contract.window
    out = scope.df.agg(F.min(d).alias("seen_lo"), F.max(d).alias("seen_hi"),
                       F.count_if(c.isNull()).alias("undated"))
    if not w:
        return out.select(F.col("seen_lo").alias("lo"), F.col("seen_hi").alias("hi"), "*",
                          F.lit(False).alias("starts_late"), F.lit(False).alias("ends_early"),
                          F.lit(False).alias("opens_mid_period"))
    return out.select(F.lit(w.start).alias("lo"), F.lit(w.end).alias("hi"), "*",
                      (F.col("seen_lo") > F.lit(w.start)).alias("starts_late"),
                      (F.col("seen_hi") < F.lit(w.end)).alias("ends_early"),
                      F.lit(label_start(w.start, grain) != w.start).alias("opens_mid_period"))


def empty_months(scope, label: str, grain: str) -> DataFrame:
    """Months inside one quarter or year that hold no rows, clipped to the window."""
    g = checked_grain(grain)
    if g not in ("quarter", "year"):
        raise Refused("BAD_GRAIN", "only a quarter or a year has months inside it")
    lo = label_start(label, g)
    hi = label_start(lo + dt.timedelta(days=95 if g == "quarter" else 370), g) - dt.timedelta(days=1)
    w = scope.contract.window
    if w:
        lo, hi = max(lo, w.start), min(hi, w.end)
    months = spine(scope.df.sparkSession, lo, hi, "month")
    c = F.col(scope.contract.require_date())
    held = (scope.df.where((c >= F.lit(lo)) & (c < F.date_add(F.lit(hi), 1)))
            .select(trunc_to("month", c).alias("period")).distinct())
    return months.join(held, "period", "left_anti").select(F.col("period").alias("month"))
