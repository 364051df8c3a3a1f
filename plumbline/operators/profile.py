"""What every column holds: counts, ranges, readable types, lengths, coverage and a role.

Distinct counts of all columns take two shuffles: one of bitmaps, for columns of whole numbers, dates and flags that lie
densely enough, merged before they move; one of values for the rest. Every column is projected by itself, so a columnar source
is read once in total and no row is multiplied, as several count(distinct) in one aggregate would.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggs import FLOATING, INTEGRAL, NUMERIC, TEMPORAL, finite, is_kind, non_finite_count
from ..functions.quantiles import grouped
from ..functions.staging import spread, stage
from ..functions.words import IDENTIFIER, MISSING, snake
from .periods import islands, spine


@dataclass(frozen=True)
class Column_:
    """Counted facts about one column; one of these per column, never per row."""

    name: str
    dtype: T.DataType
    position: int
    rows: int
    non_null: int
    distinct: int
    low: str | None
    high: str | None

    @property
    def numeric(self) -> bool:
        return isinstance(self.dtype, NUMERIC)

    @property
    def whole(self) -> bool:
        return isinstance(self.dtype, INTEGRAL) or (
            isinstance(self.dtype, T.DecimalType) and self.dtype.scale == 0)

    @property
    def temporal(self) -> bool:
        return isinstance(self.dtype, TEMPORAL)

    @property
    def text(self) -> bool:
        return isinstance(self.dtype, T.StringType)

    @property
    def flag(self) -> bool:
        if isinstance(self.dtype, T.BooleanType):
            return self.distinct == 2
        return (self.numeric and self.distinct == 2 and self.low is not None
                and float(self.low) == 0 and float(self.high) == 1)

    @property
    def unique(self) -> bool:
        return self.rows > 0 and self.distinct == self.rows

    @property
    def constant(self) -> bool:
        return self.distinct <= 1


def countable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


#: Numbers in one bitmap, and the rows there have to be for each bitmap between a column's ends: as many as fill its bytes.
BITS, ROWS_A_BITMAP = 32_768, 512


def _whole(df: DataFrame, c: str) -> Column | None:
    """The column's values as whole numbers, one for each, where its type allows."""
    kind, x = df.schema[c].dataType, F.col(f"`{c}`")
    if isinstance(kind, (*INTEGRAL, T.BooleanType)):
        return x.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(x).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(x)
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (x * F.lit(10 ** kind.scale)).cast("long")
    return None


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    """Exact distinct values of each column, NULL left out."""
    return {c: f["distinct"] for c, f in _facts(df, columns or countable(df))[1].items()}


def _facts(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, dict]]:
    """Rows, and per column: non_null, low, high (finite, as text) and distinct."""
    typed = [c for c in columns if not isinstance(df.schema[c].dataType, T.StringType)]
    # text has its own way below: its minimum would take the numbers' aggregate out of code generation
    wide = _wide(df, typed).first()
    facts = {c: {"non_null": wide[f"n{i}"], "low": wide[f"lo{i}"], "high": wide[f"hi{i}"], "distinct": 0} for i, c in enumerate(typed)}
    bits, values = [], []
    for i, c in enumerate(columns):
        whole, kind = _whole(df, c), df.schema[c].dataType
        if whole is not None:
            first, last = wide[f"first{typed.index(c)}"], wide[f"last{typed.index(c)}"]
            if first is None:
                continue
            if last - first < max(1, wide["rows"] // ROWS_A_BITMAP) * BITS:
                bits.append(df.select(F.lit(i).alias("i"), F.bitmap_bucket_number(whole).alias("bucket"), F.bitmap_bit_position(whole).alias("bit")))
                continue
        x = F.col(f"`{c}`")
        number = x.cast("double") if isinstance(kind, FLOATING) else F.lit(None).cast("double")
        text = x.cast("string") if whole is None and not isinstance(kind, FLOATING) else F.lit(None).cast("string")
        values.append(df.where(x.isNotNull()).select(
            F.lit(i).alias("i"), (F.lit(None).cast("long") if whole is None else whole).alias("whole"), number.alias("number"), text.alias("text")))
    parts = []
    if bits:
        merged = reduce(DataFrame.unionAll, bits).where("bit IS NOT NULL").groupBy("i", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        parts.append(merged.groupBy("i").agg(F.sum(F.bitmap_count("bits")).alias("distinct"), *[F.lit(None).alias(k) for k in ("n", "low", "high")]))
    if values:
        each = reduce(DataFrame.unionAll, values).groupBy("i", "whole", "number", "text").agg(F.count("*").alias("n"))
        parts.append(each.groupBy("i").agg(F.count("*").alias("distinct"), F.sum("n").alias("n"), F.min("text").alias("low"), F.max("text").alias("high")))
    counted = parts[0].unionAll(parts[1]) if len(parts) == 2 else parts[0] if parts else None
    for r in counted.collect() if parts else ():  # one row per column
        held = facts.setdefault(columns[r["i"]], {"non_null": r["n"], "low": r["low"], "high": r["high"]})
        held["distinct"] = r["distinct"]
    none = {"non_null": 0, "low": None, "high": None, "distinct": 0}
    return wide["rows"], {c: facts.get(c, none) for c in columns}


def _wide(df: DataFrame, columns: list[str]) -> DataFrame:
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        x = finite(df, c) if is_kind(df, c, FLOATING) else F.col(f"`{c}`")
        aggs += [F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.min(x).cast("string").alias(f"lo{i}"),
                 F.max(x).cast("string").alias(f"hi{i}")]
        whole = _whole(df, c)
        if whole is not None:
            aggs += [F.min(whole).alias(f"first{i}"), F.max(whole).alias(f"last{i}")]
    return df.agg(*aggs)


PROFILE = "column string, position int, rows long, non_null long, low string, high string, distinct long"


def prof_columns(df: DataFrame) -> DataFrame:
    """One row per column: rows, non-null, exact distinct, finite min and max as text."""
    columns = countable(df)
    if not columns:
        return rows_frame(df, [], PROFILE)
    rows, facts = _facts(df, columns)
    return rows_frame(df, [(c, i, rows, *(facts[c][k] for k in ("non_null", "low", "high", "distinct"))) for i, c in enumerate(columns)], PROFILE)


def evidence(df: DataFrame) -> list[Column_]:
    """``prof_columns`` on the driver: a row per column of the table."""
    types = {f.name: f.dataType for f in df.schema.fields}
    got = prof_columns(df).collect()
    return [Column_(r["column"], types[r["column"]], r["position"], r["rows"], r["non_null"],
                    r["distinct"], r["low"], r["high"])
            for r in sorted(got, key=lambda r: r["position"])]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def as_rows(wide: DataFrame, names: list[str], fields: list[str]) -> DataFrame:
    """A wide aggregate (field__column) as one row per column."""
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{f}__{i}").alias(f) for f in fields])
        for i, c in enumerate(names)])))


def prof_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean, deviation, quartiles and non-finite count of every numeric column in one aggregate."""
    columns = columns or numeric_columns(df)
    x = {f"__x{i}": finite(df, c).cast("double") for i, c in enumerate(columns)}
    aggs, qs = [], {}
    for i, c in enumerate(columns):
        aggs += [F.avg(f"__x{i}").alias(f"mean__{i}"), F.stddev_samp(f"__x{i}").alias(f"sd__{i}"),
                 non_finite_count(df, c).alias(f"non_finite__{i}")]
        qs.update({f"q1__{i}": (f"__x{i}", .25), f"median__{i}": (f"__x{i}", .5),
                   f"q3__{i}": (f"__x{i}", .75)})
    wide = grouped(df.withColumns(x), [], aggs, qs)
    return as_rows(wide, columns, ["mean", "sd", "q1", "median", "q3", "non_finite"])


OUTLIER_K = 1.5


def prof_outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Values outside Tukey's fences per numeric column; NULL where the quartiles coincide."""
    columns = columns or numeric_columns(df)
    # one row per numeric column
    fences = {r["column"]: (r["q1"], r["q3"]) for r in prof_numeric(df, columns).collect()}
    aggs = []
    for i, c in enumerate(columns):
        q1, q3 = fences[c]
        x = finite(df, c)
        if q1 is None or q3 == q1:
            none = F.lit(None)
            aggs += [none.cast("double").alias(f"lower__{i}"), none.cast("double").alias(f"upper__{i}"),
                     F.max(none.cast("long")).alias(f"below__{i}"),
                     F.max(none.cast("long")).alias(f"above__{i}")]
            continue
        lo, hi = q1 - OUTLIER_K * (q3 - q1), q3 + OUTLIER_K * (q3 - q1)
        aggs += [F.lit(lo).alias(f"lower__{i}"), F.lit(hi).alias(f"upper__{i}"),
                 F.count_if(x < F.lit(lo)).alias(f"below__{i}"),
                 F.count_if(x > F.lit(hi)).alias(f"above__{i}")]
    return as_rows(df.agg(*aggs), columns, ["lower", "upper", "below", "above"])


def prof_text(df: DataFrame, columns: list[str] | None = None, tokens=MISSING) -> DataFrame:
    """Blank values and missing-value tokens per text column."""
    columns = columns or text_columns(df)
    aggs = []
    for i, c in enumerate(columns):
        v = F.trim(F.col(c))
        aggs += [F.count_if(v == "").alias(f"blank__{i}"),
                 F.count_if(F.upper(v).isin(*tokens)).alias(f"missing__{i}")]
    return as_rows(df.agg(*aggs), columns, ["blank", "missing"])


def prof_missing_tokens(df: DataFrame, columns: list[str] | None = None, tokens=MISSING) -> DataFrame:
    """Which token, as written, in which column, how often."""
    parts = []
    for c in columns or text_columns(df):
        v = F.trim(F.col(c))
        parts.append(df.where(F.upper(v).isin(*tokens)).groupBy(v.alias("token")).agg(
            F.count("*").alias("rows")).select(F.lit(c).alias("column"), "token", "rows"))
    return reduce(DataFrame.unionAll, parts)


# Types a text column may be read as, narrowest first, and how a date must open.
READINGS = ("bigint", "double", "date", "timestamp", "boolean")
DATE_SHAPE = r"^\s*\d{4}-\d{1,2}-\d{1,2}"


def reads_as(c: Column, kind: str) -> Column:
    """Whether text reads as a type without losing anything."""
    if kind == "bigint":
        d = c.try_cast("double")
        return F.coalesce((d == F.floor(d).cast("double")) & (F.abs(d) < F.lit(9.2e18)), F.lit(False))
    if kind == "double":
        return c.try_cast("double").isNotNull()
    if kind == "boolean":
        return F.lower(F.trim(c)).isin("true", "false", "t", "f", "1", "0")
    stamp = F.when(c.rlike(DATE_SHAPE), c).try_cast("timestamp_ntz")
    if kind == "timestamp":
        return stamp.isNotNull()
    return F.coalesce(stamp == F.date_trunc("day", stamp).cast("timestamp_ntz"), F.lit(False))


def judged(c: Column, tokens=MISSING) -> Column:
    """Present, not blank and not a word for missing."""
    v = F.trim(c)
    return c.isNotNull() & (v != "") & ~F.upper(v).isin(*tokens)


def prof_type_reading(df: DataFrame, columns: list[str] | None = None, tokens=MISSING) -> DataFrame:
    """Share of text values that read as each type; the narrowest best one.

    Values are judged where they are read, all columns in one pass: no text is moved.
    """
    columns = columns or text_columns(df)
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"v{i}")
        money = F.when(v.rlike("[₹$€£¥,]"), F.regexp_replace(v, r"[₹$€£¥,\s]", "")).try_cast("double").isNotNull()
        aggs += [F.count(v).alias(f"considered__{i}"), *[F.count_if(reads_as(v, k)).alias(f"{k}__{i}") for k in READINGS],
                 F.count_if(v.rlike("^[+-]?0[0-9]")).alias(f"leading_zero__{i}"), F.count_if(money).alias(f"currency__{i}")]
    read = spread(df.select(*columns)).select(*[F.when(judged(F.col(c), tokens), F.col(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    out = as_rows(read.agg(*aggs), columns, ["considered", *READINGS, "leading_zero", "currency"])
    top = F.greatest(*[F.col(k) for k in READINGS])
    best = F.lit(None).cast("string")
    for k in reversed(READINGS):
        best = F.when((F.col(k) == top) & (top > 0), k).otherwise(best)
    return out.withColumn("best", best).withColumn("ratio", F.try_divide(top, F.col("considered")))


def unread_examples(df: DataFrame, column: str, kind: str, limit: int = 3) -> DataFrame:
    """The first few distinct values that do not read as a type."""
    v = F.col(column)
    return (df.where(judged(v) & ~reads_as(v, kind)).select(v.alias("value")).distinct()
            .orderBy("value").limit(limit))


def full_row_counts(df: DataFrame) -> DataFrame:
    """Each distinct row with its number of copies; NULL equals NULL."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("copies"))


def prof_duplicates(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and exact copies.

    Rows are screened by a 64-bit hash, which keeps the shuffle narrow; only tables where the screen
    finds repeats pay for the exact grouping of whole rows.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    screen = df.select(F.xxhash64(*cols).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    s = screen.agg(F.sum("n").alias("rows"), F.count("*").alias("hashes")).first()
    rows = s["rows"] or 0
    if rows == s["hashes"]:
        # distinct hashes prove distinct rows
        return df.sparkSession.range(1).select(
            F.lit(rows).cast("long").alias("rows"), F.lit(rows).cast("long").alias("distinct_rows"),
            F.lit(0).cast("long").alias("duplicates"))
    exact = full_row_counts(df).agg(F.count("*"))
    return df.agg(F.count("*").alias("rows")).select(
        "rows", exact.scalar().alias("distinct_rows"), (F.col("rows") - exact.scalar())
        .alias("duplicates"))


def prof_top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    total = df.agg(F.count("*"))
    return (counts.orderBy(F.desc("rows"), F.asc_nulls_last("value")).limit(n)
            .withColumn("share", F.col("rows") / total.scalar()))


def nice_step(span: float, bins: int) -> float:
    """The smallest of 1, 2, 5 times a power of ten that covers the span in ``bins`` steps."""
    raw = span / bins
    power = 10.0 ** math.floor(math.log10(raw))
    return next(m * power for m in (1.0, 2.0, 5.0, 10.0) if m * power >= raw * (1 - 1e-12))


def prof_histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins on readable boundaries, closed on the right."""
    x = finite(df, column).cast("double")
    b = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if b["lo"] is None:
        return df.sparkSession.range(0).selectExpr("0.0D AS lo", "0.0D AS hi", "0L AS rows")
    step = nice_step(b["hi"] - b["lo"], bins) if b["hi"] > b["lo"] else 1.0
    first = math.ceil(b["lo"] / step) - (1 if b["hi"] == b["lo"] else 0)
    last = max(math.ceil(b["hi"] / step), first)
    k = F.greatest(F.ceil(x / F.lit(step)), F.lit(first))
    counts = df.where(x.isNotNull()).groupBy(k.alias("k")).agg(F.count("*").alias("rows"))
    frame = df.sparkSession.range(first, last + 1).select(F.col("id").alias("k"))
    return frame.join(F.broadcast(counts), "k", "left").select(
        ((F.col("k") - 1) * F.lit(step)).alias("lo"), (F.col("k") * F.lit(step)).alias("hi"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def prof_lengths(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or text_columns(df)
    aggs = []
    for i, c in enumerate(columns):
        n = F.length(c)
        aggs += [F.min(n).alias(f"shortest__{i}"), F.max(n).alias(f"longest__{i}"),
                 F.avg(n).alias(f"mean__{i}"), (F.min(n) == F.max(n)).alias(f"fixed_width__{i}")]
    return as_rows(df.agg(*aggs), columns, ["shortest", "longest", "mean", "fixed_width"])


def days_present(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("date").alias("period")).where(
        F.col("period").isNotNull()).distinct()


def missing_days(df: DataFrame, column: str) -> DataFrame:
    """Days between the first and last that hold no row."""
    present = stage(days_present(df, column))       # one row per calendar day
    b = present.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).first()
    days = spine(df.sparkSession, b["lo"], b["hi"], "day")
    return days.join(present, "period", "left_anti").select(F.col("period").alias("day"))


def prof_date_coverage(df: DataFrame, column: str) -> DataFrame:
    """First and last day, days in the span, present, missing and the longest gap."""
    present = stage(days_present(df, column))
    b = present.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).first()
    days = spine(df.sparkSession, b["lo"], b["hi"], "day")
    gone = days.join(present, "period", "left_anti")
    runs = islands(gone, F.datediff("period", F.lit("1970-01-01").cast("date")), F.lit(True))
    longest = runs.agg(F.coalesce(F.max("length"), F.lit(0)))
    span = F.datediff("last", "first") + 1
    out = present.agg(F.min("period").alias("first"), F.max("period").alias("last"),
                      F.count("*").alias("present"))
    return out.select("first", "last", span.cast("long").alias("days_in_span"), "present",
                      (span - F.col("present")).cast("long").alias("missing"),
                      longest.scalar().cast("long").alias("longest_gap"))


# Where text stops being a category, and a number a bucket.
FREE_TEXT_RATIO, SMALL_NUMERIC = 0.5, 12


def role_of(c: Column_) -> str:
    """identifier, dimension, measure, date, flag, free_text or ignore, from counts and the name."""
    many = c.rows > 1
    named = bool(set(snake(c.name).split("_")) & IDENTIFIER)
    if c.rows and c.non_null == 0:
        return "ignore"
    if c.temporal:
        return "date"
    if isinstance(c.dtype, T.BooleanType):
        return "flag"
    if (many and c.unique and not c.numeric) or named:
        return "identifier"
    if many and c.constant:
        return "ignore"
    if c.numeric:
        return "dimension" if many and c.whole and c.distinct <= SMALL_NUMERIC else "measure"
    if c.text and many and c.distinct >= FREE_TEXT_RATIO * c.rows:
        return "free_text"
    return "dimension"


def rows_frame(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Per-column findings (never per-row data) as a frame."""
    return df.sparkSession.createDataFrame(rows, schema)


def prof_roles(df: DataFrame) -> DataFrame:
    return rows_frame(df, [(c.name, role_of(c), c.distinct, c.rows) for c in evidence(df)],
                      "column string, role string, distinct long, rows long")
