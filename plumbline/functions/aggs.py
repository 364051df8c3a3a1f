"""Declared aggregates as Column factories, and the rules about which of them add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import ADDITIVE, Measure
from ..errors import Refused

FLOATING = (T.DoubleType, T.FloatType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = FLOATING + INTEGRAL + (T.DecimalType,)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_kind(df: DataFrame, column: str, kinds) -> bool:
    return isinstance(df.schema[column].dataType, kinds)


def finite(df: DataFrame, column: str) -> Column:
    """The column with NaN and infinities read as NULL; free for exact types."""
    c = F.col(column)
    if not is_kind(df, column, FLOATING):
        return c
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def non_finite_count(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    if not is_kind(df, column, FLOATING):
        return F.lit(0).cast("long")
    return F.count_if(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))


def total_needed(m: Measure) -> str:
    if m.agg == "level":
        raise Refused("USE_LEVELS", f"{m.name} is a level: the last value over time, then a sum over units")
    if m.agg in (None, "none"):
        raise Refused("NO_TOTAL", f"{m.name} declares agg={m.agg}: it does not combine across rows")
    return m.agg


def row_values_needed(m: Measure) -> Measure:
    if m.of_sums:
        raise Refused("RATIO_HAS_NO_ROW_VALUE", f"{m.name} is a ratio of sums")
    return m


def additive_needed(m: Measure) -> str:
    if m.agg not in ADDITIVE:
        raise Refused("NOT_ADDITIVE", f"{m.name} is agg={m.agg}; only sums and counts add up")
    return m.agg


def steady_sum(c: Column) -> Column:
    """A sum of doubles in which the order of the rows does not show, so that equal groups tie.

    Six decimals are added exactly; what a value has beyond them, and values without them (10 ** 15 on), are added as doubles.
    """
    exact = F.when(F.abs(c) < F.lit(1e15), c.cast("decimal(38,6)"))
    rest = F.when(exact.isNull(), c).otherwise(c - exact.cast("double"))
    return F.coalesce(F.sum(exact).cast("double"), F.lit(0.0)) + F.sum(rest)


def declared(m: Measure, where: Column | None = None, floating: bool = False) -> Column:
    """The measure's own aggregate, optionally over the rows ``where`` holds for; ``floating``: of doubles, by steady sums.

    ``median`` is left out on purpose: it goes through functions.quantiles, which checks how many
    distinct values a group can hold first.
    """
    agg = total_needed(m)

    def keep(c: Column) -> Column:
        return c if where is None else F.when(where, c)

    c = F.col(m.name)
    if m.of_sums:
        return F.try_divide(F.sum(keep(c["n"])), F.sum(keep(c["d"])))
    if floating and agg == "sum":
        return steady_sum(keep(c))
    if floating and agg == "mean":
        return F.try_divide(steady_sum(keep(c)), F.count(keep(c)))
    table = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max,
             "count": F.count, "count_distinct": F.count_distinct}
    if agg not in table:
        raise Refused("USE_QUANTILES", f"{m.name} is agg={agg}")
    return table[agg](keep(c))


def sample_skewness(column: str | Column, n: Column) -> Column:
    """Bias-corrected skewness from Spark's population form; NULL under three values."""
    g1 = F.skewness(column)
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def sample_kurtosis(column: str | Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL under four values."""
    g2 = F.kurtosis(column)
    scale = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n > 3, scale * ((n + 1) * g2 + 6))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson r, NULL instead of a division error when a side is flat."""
    both = x.isNotNull() & y.isNotNull()
    gx, gy = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    mx, my = F.min(gx) != F.max(gx), F.min(gy) != F.max(gy)
    # corr itself divides by the two spreads, so its inputs are only evaluated through try-safe
    # moments: cov / (sd * sd).
    r = F.try_divide(F.covar_pop(gx, gy), F.stddev_pop(gx) * F.stddev_pop(gy))
    return F.when(mx & my, r)


def text_of(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("string")


def row_hash_sum(df: DataFrame) -> Column:
    """Order-independent fingerprint of the rows."""
    return F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))
