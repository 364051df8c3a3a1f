"""Measures that don't add up over time, as states that do: levels and distinct counts for any calendar.

A state is written once from the rows, at the grain of a day. Periods of any length are then answered from the state alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import Measure
from ..errors import Refused
from ..functions.staging import ranked, stage
from .periods import spine_array, trunc_to
from .scope import Scope


def _level(scope: Scope, measure: str) -> Measure:
    m = scope.contract.measure(measure)
    if m.agg != "level":
        raise Refused("NOT_A_LEVEL", f"{measure} is agg={m.agg}")
    return m


def level_changes(scope: Scope, measure: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``day, [by], change, started``: by how much the sum over units changed on a day, and how many units had their first level.

    A unit's level on a day is the last one of that day (the larger of two at one time); it holds until the next. Changes add
    up: over units, and over the days of any calendar. Rows without a time, a unit or a level say nothing. With ``by``, a unit
    has a level of its own in each member.
    """
    m, at = _level(scope, measure), scope.contract.require_date()
    known = scope.df.where(F.col(at).isNotNull() & F.col(m.name).isNotNull())
    for c in m.per:
        known = known.where(F.col(c).isNotNull())
    unit = [F.col(c) for c in (*m.per, *by)]
    # one row per unit and day, merged before the shuffle: a unit is no longer than the calendar
    last = known.groupBy(*unit, F.col(at).cast("date").alias("day")).agg(F.max(F.struct(F.col(at).alias("at"), F.col(m.name).cast("double").alias("level"))).alias("l"))
    before = F.lag("l.level").over(Window.partitionBy(*m.per, *by).orderBy("day"))
    moves = last.select("day", *by, (F.col("l.level") - F.coalesce(before, F.lit(0.0))).alias("change"), before.isNull().cast("long").alias("started"))
    return moves.groupBy("day", *by).agg(F.sum("change").alias("change"), F.sum("started").alias("started"))


def levels(changes: DataFrame, grain: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``period, [by], level, units``: the sum of the units' levels at each period's end, and how many units had one.

    Periods without rows carry on what was there. ``changes`` (staged: it is read twice) is what ``level_changes`` gives; the
    window below runs over a calendar.
    """
    ends = changes.agg(F.min("day"), F.max("day")).first()
    if ends[0] is None:
        return changes.select(F.col("day").alias("period"), *by, F.col("change").alias("level"), F.col("started").alias("units"))
    moves = changes.groupBy(trunc_to(grain, F.col("day")).alias("period"), *by).agg(F.sum("change").alias("change"), F.sum("started").alias("started"))
    every = changes.sparkSession.range(1).select(F.explode(spine_array(ends[0], ends[1], grain)).alias("period"))
    if by:
        every = changes.select(*by).distinct().select(*by, F.explode(spine_array(ends[0], ends[1], grain)).alias("period"))
    same = every["period"] == moves["period"]
    for c in by:
        same = same & every[c].eqNullSafe(moves[c])
    rows = every.join(moves, same, "left").select(every["period"], *[every[c] for c in by], "change", "started")
    upto = Window.partitionBy(*by).orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level, units = F.sum(F.coalesce("change", F.lit(0.0))).over(upto), F.sum(F.coalesce("started", F.lit(0))).over(upto)
    return rows.select("period", *by, level.alias("level"), units.alias("units")).where("units > 0")


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``value, id``: a dictionary of the distinct values of a column, numbered from 1 in their order."""
    values = stage(df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct())
    return ranked(values, [F.col("value")], "id")


def distinct_state(df: DataFrame, at: str, id_: Column | str, by: tuple[str, ...] = ()) -> DataFrame:
    """``day, [by], bucket, bits``: which whole numbers were seen on a day, one bit each, 32,768 to a row.

    States merge by OR and count exactly. Numbers should be dense (``numbered`` makes them so): a row of bits has a fixed size
    whatever it holds, and compresses when it holds little. Null numbers and days are left out.
    """
    n = F.col(id_) if isinstance(id_, str) else id_
    rows = df.select(F.col(at).cast("date").alias("day"), *by, n.cast("long").alias("n")).where("day IS NOT NULL AND n IS NOT NULL")
    return rows.groupBy("day", *by, F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


def distinct_over(state: DataFrame, period: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``[period], [by], distinct``: exact distinct counts per period (any expression of ``day``), from the state alone."""
    keys = ([period.alias("period")] if period is not None else []) + [F.col(c) for c in by]
    names = (["period"] if period is not None else []) + list(by)
    merged = state.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*names).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("distinct"))
