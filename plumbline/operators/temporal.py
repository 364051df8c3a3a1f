"""Tier 3: measures on a calendar whose empty periods stay visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.aggs import additive_needed, declared, total_needed
from ..functions.staging import stage
from .periods import (bounds, checked_grain, empty_months, label_start, measured_per_period,
                      numbered, on_calendar, per_period, spine_array, trunc_to)
from .scope import Scope


def calendar_coverage(scope: Scope, grain: str = "month") -> DataFrame:
    """One row per period with its row count; an empty period is a row, not an absence."""
    cal = on_calendar(scope, per_period(scope, [F.count("*").alias("rows")], grain), grain)
    return cal.select("period", "rows", (F.col("rows") > 0).alias("present"))


def trend(scope: Scope, measure: str, grain: str = "month", dimension: str | None = None
          ) -> DataFrame:
    """Value per period (and per member, beside an all-rows series), NULL where nothing was."""
    total_needed(scope.contract.measure(measure))
    scope = scope.for_measure(measure, [dimension] if dimension else [], date=True)
    if dimension is None:
        out = on_calendar(scope, measured_per_period(scope, measure, grain), grain)
        return out.select("period", F.col("value").cast("double").alias("value"), "rows")
    scope.contract.dimension(dimension)
    # one row per member and period that has rows
    cells = stage(measured_per_period(scope, measure, grain, [dimension]))
    members = cells.select(dimension).distinct()
    lo, hi = bounds(scope)
    grid = members.withColumn("period", F.explode(spine_array(lo, hi, grain)))
    # one grid row per (member, period)
    other = cells.select(F.col("period").alias("p2"), F.col(dimension).alias("d2"), "value", "rows")
    split = grid.join(other, (F.col("period") == F.col("p2"))
                      & F.col(dimension).eqNullSafe(F.col("d2")), "left")
    split = split.select("period", F.lit("member").alias("series"), F.col(dimension).alias("member"),
                         F.col("value").cast("double").alias("value"),
                         F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
    whole = on_calendar(scope, measured_per_period(scope, measure, grain), grain)
    whole = whole.select("period", F.lit("all").alias("series"),
                         F.lit(None).cast(scope.df.schema[dimension].dataType).alias("member"),
                         F.col("value").cast("double").alias("value"), "rows")
    return split.unionByName(whole)


def trend_ends(scope: Scope, measure: str, grain: str = "month") -> DataFrame:
    """First and last period that hold rows, and the change between them."""
    t = trend(scope, measure, grain).where(F.col("rows") > 0)
    return t.agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"),
                 F.min_by("value", "period").alias("first_value"),
                 F.max_by("value", "period").alias("last_value")).withColumn(
        "change", F.col("last_value") - F.col("first_value"))


CYCLES = {"day": lambda p: F.weekday(p) + 1, "week": F.weekofyear, "month": F.month,
          "quarter": F.quarter}


def seasonality(scope: Scope, measure: str, grain: str = "month") -> DataFrame:
    """Periods folded onto their position in the cycle; means over the periods that hold rows."""
    g = checked_grain(grain)
    if g not in CYCLES:
        raise Refused("BAD_GRAIN", "a year has no cycle to fold onto")
    total_needed(scope.contract.measure(measure))
    cal = on_calendar(scope, measured_per_period(scope, measure, g), g)
    folded = cal.groupBy(CYCLES[g](F.col("period")).cast("int").alias("position")).agg(
        F.avg("value").alias("mean"), F.count("value").alias("observed"),
        (F.count("*") - F.count("value")).alias("absent"), F.sum("rows").alias("rows"))
    grand = cal.agg(F.avg("value"))
    return folded.select("position", "mean", F.try_divide("mean", grand.scalar()).alias("index"),
                         "observed", "absent", "rows")


def period_compare(scope: Scope, measure: str, period: str, baseline: str, grain: str = "month"
                   ) -> DataFrame:
    """Two named periods beside each other; a percentage only over a positive baseline."""
    g = checked_grain(grain)
    total_needed(scope.contract.measure(measure))
    p1, p0 = label_start(period, g), label_start(baseline, g)
    if p0 == p1:
        raise Refused("SAME_PERIOD", "a period cannot be compared with itself")
    lo, hi = bounds(scope)
    for p in (p0, p1):
        if not label_start(lo, g) <= p <= hi:
            raise Refused("UNKNOWN_PERIOD", f"{p} is outside the calendar")
    c = F.col(scope.contract.require_date())
    near = Scope(scope.df.where(trunc_to(g, c).isin(p0, p1)), scope.contract)
    m = scope.contract.measure(measure)
    if m.agg == "median":
        two = measured_per_period(near, measure, g).join(
            per_period(near, [F.count_distinct(c.cast("date")).alias("days")], g), "period")
    else:
        two = per_period(near, [declared(m).cast("double").alias("value"),
                                F.count("*").alias("rows"),
                                F.count_distinct(c.cast("date")).alias("days")], g)

    def pick(name: str, p) -> Column:
        return F.max(F.when(F.col("period") == F.lit(p), F.col(name)))

    def held(name: str, p) -> Column:
        return F.coalesce(pick(name, p), F.lit(0)).cast("long")

    out = two.agg(pick("value", p0).alias("baseline_value"), pick("value", p1).alias("period_value"),
                  held("rows", p0).alias("baseline_rows"), held("rows", p1).alias("period_rows"),
                  held("days", p0).alias("baseline_days"), held("days", p1).alias("period_days"))
    diff = F.col("period_value") - F.col("baseline_value")
    return out.select("*", diff.alias("difference"),
                      F.when(F.col("baseline_value") > 0, diff / F.col("baseline_value") * 100)
                      .alias("percent"))


def compared_empty_months(scope: Scope, period: str, baseline: str, grain: str) -> DataFrame:
    """Months without rows inside either compared quarter or year."""
    parts = [empty_months(scope, lab, grain).select(F.lit(lab).alias("label"), "month")
             for lab in (baseline, period)]
    return parts[0].unionByName(parts[1])


def _two_periods(scope: Scope, period: str, baseline: str, grain: str):
    g = checked_grain(grain)
    p1, p0 = label_start(period, g), label_start(baseline, g)
    if p0 == p1:
        raise Refused("SAME_PERIOD", "a period cannot be compared with itself")
    t = trunc_to(g, F.col(scope.contract.require_date()))
    near = scope.df.withColumn("__p", t).where(F.col("__p").isin(p0, p1))
    return near, F.col("__p") == F.lit(p0), F.col("__p") == F.lit(p1)


def growth_decomposition(scope: Scope, measure: str, dimension: str, period: str, baseline: str,
                         grain: str = "month") -> DataFrame:
    """Each member's part of the change between two periods; the parts add to the whole."""
    m = scope.contract.measure(measure)
    additive_needed(m)
    scope.contract.dimension(dimension)
    scope = scope.for_measure(measure, [dimension], date=True)
    near, is0, is1 = _two_periods(scope, period, baseline, grain)
    parts = stage(near.groupBy(F.col(dimension).alias("member")).agg(
        declared(m, is0).cast("double").alias("__s0"), declared(m, is1).cast("double").alias("__s1"),
        F.count_if(is0).alias("baseline_rows"), F.count_if(is1).alias("period_rows")))
    v0 = F.when(F.col("baseline_rows") > 0, F.col("__s0"))
    v1 = F.when(F.col("period_rows") > 0, F.col("__s1"))
    change = F.coalesce(v1, F.lit(0.0)) - F.coalesce(v0, F.lit(0.0))
    total = parts.agg(F.sum(change)).first()[0]
    share = F.lit(None).cast("double") if not total else change / F.lit(float(total))
    return parts.select("member", v0.alias("baseline_value"), v1.alias("period_value"),
                        change.alias("change"), share.alias("share_of_change"),
                        (F.col("baseline_rows") == 0).alias("entrant"),
                        (F.col("period_rows") == 0).alias("leaver"))


def growth_summary(decomposed: DataFrame) -> DataFrame:
    """Net and gross movement, members up and down, entrants and leavers."""
    return decomposed.agg(
        F.sum("change").alias("net"), F.sum(F.abs("change")).alias("gross"),
        F.count_if(F.col("change") > 0).alias("rose"), F.count_if(F.col("change") < 0).alias("fell"),
        F.count_if("entrant").alias("entrants"), F.count_if("leaver").alias("leavers"))


def mix_shift(scope: Scope, measure: str, dimension: str, period: str, baseline: str,
              grain: str = "month") -> DataFrame:
    """A change in an overall mean split into rate, mix and interaction per member."""
    m = scope.contract.measure(measure)
    if m.agg != "mean":
        raise Refused("NOT_A_MEAN", f"{measure} is agg={m.agg}; mix_shift splits a mean")
    scope.contract.dimension(dimension)
    near, is0, is1 = _two_periods(scope, period, baseline, grain)
    x = F.col(measure)
    g = stage(near.groupBy(F.col(dimension).alias("member")).agg(
        F.avg(F.when(is0, x)).alias("m0"), F.avg(F.when(is1, x)).alias("m1"),
        F.count(F.when(is0, x)).alias("n0"), F.count(F.when(is1, x)).alias("n1")))
    t = g.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not t["n0"] or not t["n1"]:
        raise Refused("EMPTY_PERIOD", "both periods need values")
    g = g.where((F.col("n0") > 0) | (F.col("n1") > 0))
    w0, w1 = F.col("n0") / F.lit(t["n0"]), F.col("n1") / F.lit(t["n1"])
    dm, dw = F.col("m1") - F.col("m0"), w1 - w0
    part0 = F.coalesce(w0 * F.col("m0"), F.lit(0.0))
    part1 = F.coalesce(w1 * F.col("m1"), F.lit(0.0))
    return g.select("member", F.col("m0").alias("baseline_mean"), F.col("m1").alias("period_mean"),
                    w0.alias("baseline_share"), w1.alias("period_share"),
                    (w0 * dm).alias("rate"), (F.when(dm.isNotNull(), F.col("m0") * dw)).alias("mix"),
                    (dw * dm).alias("interaction"), (part1 - part0).alias("contribution"))


def positions(scope: Scope, measure: str, grain: str) -> DataFrame:
    """The numbered calendar series other analyses read."""
    return numbered(on_calendar(scope, measured_per_period(scope, measure, grain), grain))
