"""Cleaning: proposed actions with what they touch and what they lose, applied lazily in order.

An ``Action`` holds one column expression. Affected rows, lost rows and the change itself all come
from that expression, so the plan cannot say one thing and the run do another.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..functions.aggs import FLOATING, is_kind
from ..functions.staging import spread, stage
from ..functions.words import MISSING
from ..sources import versions
from .profile import DATE_SHAPE, countable, full_row_counts, prof_duplicates, text_columns

#: Share of values a conversion has to read before it is proposed.
MIN_SHARE = 0.9
#: Characters up to which a text value may be moved to be counted; the answer is the same for every number.
SHORT = 64

# Characters money carries, and a number that starts with a zero it would lose.
CURRENCY = r"[₹$€£¥,\s]"
LEADING_ZERO = r"^[+-]?0[0-9]"
ZERO_DATE = r"^0000-00-00([ T]00:00:00)?$"

NUMBERS = ("bigint", "decimal(18,2)", "double")


@dataclass(frozen=True)
class Action:
    kind: str
    column: str | None = None
    options: dict = field(default_factory=dict)

    @property
    def id(self) -> str:
        """Stable across proposals: the same action on the same column has the same id."""
        text = f"{self.kind}|{self.column}|{sorted(self.options.items())}"
        return hashlib.sha1(text.encode()).hexdigest()[:10]


# --- readings ------------------------------------------------------------------------------------

# Numbers as people write them, whole-value patterns.
US_NUMBER = r"^[-+]?[₹$€£¥]?\s?[-+]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?$"
EU_NUMBER = r"^[-+]?[₹$€£¥]?\s?[-+]?(\d{1,3}(\.\d{3})+|\d+)(,\d+)?$"
PERCENT = r"^[-+]?\d+([.,]\d+)?\s?%$"

# Date formats by name, in the order they are tried; two-digit years first.
GENERAL = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd",
           "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "yyyyMMdd")
DAY_FIRST = ("d/M/yy", "d.M.yy", "d-M-yy", "d/M/yyyy", "d.M.yyyy", "d-M-yyyy")
MONTH_FIRST = ("M/d/yy", "M.d.yy", "M-d-yy", "M/d/yyyy", "M.d.yyyy", "M-d-yyyy")
NUMERIC_DATE = r"^(\d{1,2})[/.-](\d{1,2})[/.-](?:\d{4}|\d{2})$"
TWO_DIGIT_YEAR = r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{2}$"
PIVOT = 69

# What a value has to look like before a format is tried on it: one pattern per format family.
SHAPES = {
    "yyyy-MM-dd": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$",
    "yyyy/MM/dd": r"^\d{4}/\d{1,2}/\d{1,2}$", "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    "MMMM d, yyyy": r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    "yyyyMMdd": r"^\d{8}$",
}


def _shape(fmt: str) -> str:
    if fmt in SHAPES:
        return SHAPES[fmt]
    sep = {"/": "/", ".": r"\.", "-": "-"}[fmt[1]]
    return rf"^\d{{1,2}}{sep}\d{{1,2}}{sep}\d{{{4 if fmt.endswith('yyyy') else 2}}}$"


def _pattern(fmt: str) -> str:
    """One-letter month and day also read two digits."""
    return fmt.replace("yyyy-MM-dd", "yyyy-M-d").replace("yyyy/MM/dd", "yyyy/M/d").replace(
        "HH:mm:ss", "H:mm:ss")


DATE_START = r"^([-+0-9]|(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))"


def _parsed(v: Column, formats) -> Column:
    """The first format that reads trimmed text; each is only tried on text of its shape."""
    got = []
    for fmt in formats:
        # names of months read in any case
        text = F.initcap(v) if "MMM" in fmt else v
        ts = F.try_to_timestamp(F.when(v.rlike(_shape(fmt)), text), F.lit(_pattern(fmt))).cast(
            "timestamp_ntz")
        if fmt.endswith("yy") and not fmt.endswith("yyyy"):
            ts = F.when(F.year(ts) % 100 >= PIVOT, ts - F.expr("INTERVAL 100 YEAR")).otherwise(ts)
        got.append(ts)
    # nothing that opens otherwise can be a date, so labels and codes skip every format
    return F.when(v.rlike(DATE_START), F.coalesce(*got))


def read_dates(c: Column, order: str | None) -> Column:
    """Text in any of the known formats as a timestamp; numeric orders only once settled.

    A two-digit year from 69 on is in the twentieth century.
    """
    first = {"day": DAY_FIRST, "month": MONTH_FIRST, None: ()}[order]
    return _parsed(F.trim(c), (*first, *GENERAL))


def accounting(c: Column) -> Column:
    """(1,234) and 1234- as negative numbers; anything else trimmed."""
    v = F.trim(c)
    return (F.when(v.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.trim(F.regexp_replace(v, r"^\(+|\)+$", ""))))
            .when(v.rlike(r"^[^-].*[0-9.,]-$"), F.concat(F.lit("-"), F.regexp_replace(v, "-+$", "")))
            .otherwise(v))


def number_text(c: Column, reading: str) -> Column:
    """The text a number cast can take, under one reading of the separators."""
    v = accounting(c)
    if reading == "percent":
        return F.replace(F.regexp_replace(v, r"\s*%+$", ""), F.lit(","), F.lit("."))
    bare = F.regexp_replace(v, r"[₹$€£¥\s]", "")
    if reading == "us":
        return F.replace(bare, F.lit(","), F.lit(""))
    if reading == "eu":
        return F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    if reading == "currency":
        return F.regexp_replace(c, CURRENCY, "")
    return F.trim(c)


#: A column name no number, date or truth value is written like.
NAME_ONLY = re.compile(r"^(?!(true|false|nan|inf|infinity|e)$)[A-Za-z_]\w*$", re.I)

BOOLEAN_WORDS = ("TRUE", "FALSE")


def converted(c: Column, o: dict) -> Column:
    """The conversion an action applies."""
    to, reading = o["to"], o.get("reading", "plain")
    if to in ("date", "timestamp"):
        ts = (read_dates(c, o.get("order")) if reading == "dates"
              else F.when(c.rlike(DATE_SHAPE), F.trim(c)).try_cast("timestamp_ntz"))
        return ts.cast("date") if to == "date" else ts
    if to == "boolean":
        return F.when(F.upper(F.trim(c)).isin(*BOOLEAN_WORDS), F.trim(c)).try_cast("boolean")
    text = number_text(c, reading)
    if to == "bigint":
        d = text.try_cast("decimal(38,6)")
        return F.when(d == F.floor(d), d).try_cast("bigint")
    return text.try_cast(to)


# --- one action ----------------------------------------------------------------------------------

def lost_value(c: Column, o: dict, tokens=MISSING) -> Column:
    """A value the conversion destroys: unreadable and not already a word for missing."""
    fails = converted(c, o).isNull()
    if o["to"] in NUMBERS:
        fails = fails | F.trim(c).rlike(LEADING_ZERO)
    if o["to"] in ("date", "timestamp"):
        fails = fails & ~F.trim(c).rlike(ZERO_DATE)
    lost = c.isNotNull() & fails
    return lost & ~F.upper(F.trim(c)).isin(*tokens) if tokens else lost


def apply_one(df: DataFrame, a: Action, tokens=MISSING) -> DataFrame:
    if a.column is not None and a.column not in df.columns:
        raise Refused("NO_SUCH_COLUMN", a.column)
    c = F.col(f"`{a.column}`") if a.column else None
    if a.kind == "convert_type":
        return df.withColumn(a.column, converted(c, a.options))
    if a.kind == "normalise_missing":
        return df.withColumn(a.column, F.when(~F.upper(F.trim(c)).isin(*tokens), c))
    if a.kind == "trim":
        return df.withColumn(a.column, F.trim(c))
    if a.kind == "case":
        return df.withColumn(a.column, F.lower(c) if a.options.get("mode") == "lower" else F.upper(c))
    if a.kind == "non_finite":
        return df.withColumn(a.column, F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c))
    if a.kind == "drop_duplicates":
        return df.dropDuplicates()
    if a.kind == "drop_header_rows":
        return df.where(~header_row(df))
    if a.kind == "exclude_column":
        return df.drop(a.column)
    raise Refused("UNKNOWN_ACTION", a.kind)


def header_row(df: DataFrame) -> Column:
    """A row that repeats at least half of the column names."""
    hits = []
    for f in df.schema.fields:
        c = f.name
        if not isinstance(f.dataType, T.StringType) and NAME_ONLY.match(c):
            continue        # a number or a date never spells a name
        names = sorted({c.lower(), c.lower().replace("_", " ")})
        v = F.lower(F.trim(F.col(f"`{c}`").cast("string")))
        hits.append(F.coalesce(v.isin(*names), F.lit(False)).cast("int"))
    need = max(2, (len(df.columns) + 1) // 2)
    return reduce(lambda a, b: a + b, hits, F.lit(0)) >= need


def impact(df: DataFrame, a: Action, tokens=MISSING, hist: DataFrame | None = None) -> DataFrame:
    """One row: id, kind, column, affected, lost, from the action's own expression."""
    head = [F.lit(a.id).alias("id"), F.lit(a.kind).alias("kind"),
            F.lit(a.column).cast("string").alias("column"),
            F.lit(", ".join(f"{k}={v}" for k, v in sorted(a.options.items()))).alias("options")]
    c = F.col(f"`{a.column}`") if a.column else None
    zero = F.lit(0).cast("long")
    if a.kind == "drop_duplicates":
        d = prof_duplicates(df)
        return d.select(*head, F.col("duplicates").alias("affected"), F.col("duplicates").alias("lost"))
    if a.kind == "drop_header_rows":
        return df.agg(F.count_if(header_row(df)).alias("n")).select(*head, F.col("n").alias("affected"),
                                                                    zero.alias("lost"))
    if a.kind == "exclude_column":
        return df.agg(F.count("*").alias("n"), F.count(c).alias("k")).select(
            *head, F.col("n").alias("affected"), F.col("k").alias("lost"))
    if a.kind == "non_finite":
        bad = F.count_if(F.isnan(c) | (F.abs(c) == float("inf")))
        return df.agg(bad.alias("n")).select(*head, F.col("n").alias("affected"), F.col("n").alias("lost"))
    # what happens to a text value depends on the value alone: judged once, weighted by its rows
    h = (hist.where(F.col("column") == a.column).select("v", "n") if hist is not None
         else df.where(c.isNotNull()).select(c.alias("v"), F.lit(1).cast("long").alias("n")))
    if a.kind == "case":
        v, n = F.col("v"), F.col("n")
        new = F.lower(v) if a.options.get("mode") == "lower" else F.upper(v)
        written = h.groupBy(_name(new).alias("k"), _name(v)).agg(F.sum(F.when(v != new, n)).alias("changed"))
        folded = written.groupBy("k").agg(F.count("*").alias("ways"), F.sum("changed").alias("changed"))
        return folded.agg(F.coalesce(F.sum("changed"), zero).alias("affected"),
                          F.coalesce(F.sum(F.col("ways") - 1), zero).alias("lost")).select(
            *head, "affected", "lost")
    affected, lost = _touched(a, tokens)
    return h.agg(_weigh(affected).alias("affected"), _weigh(lost).alias("lost")).select(
        *head, "affected", "lost")


def _weigh(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0).cast("long"))


def _touched(a: Action, tokens) -> tuple[Column, Column]:
    """Which values (v) an action on one value changes, and which it loses."""
    v = F.col("v")
    if a.kind == "convert_type":
        return v.isNotNull(), lost_value(v, a.options, tokens)
    change = {"normalise_missing": F.upper(F.trim(v)).isin(*tokens), "trim": v != F.trim(v)}[a.kind]
    return change, F.lit(False)


BY_VALUE = ("convert_type", "normalise_missing", "trim")


def _impacts(df: DataFrame, actions: list[Action], tokens, hist: DataFrame | None) -> DataFrame:
    """Impacts of a whole plan: actions on single values share one pass over the value counts."""
    single = [a for a in actions if a.kind in BY_VALUE]
    parts = [impact(df, a, tokens, hist) for a in actions if a.kind not in BY_VALUE]
    if single:
        aggs = []
        for i, a in enumerate(single):
            mine = F.col("column") == a.column
            affected, lost = _touched(a, tokens)
            aggs += [_weigh(mine & affected).alias(f"a{i}"), _weigh(mine & lost).alias(f"l{i}")]
        wide = hist.where(F.col("column").isin(sorted({a.column for a in single}))).agg(*aggs)
        parts.append(wide.select(F.inline(F.array(*[F.struct(
            F.lit(a.id).alias("id"), F.lit(a.kind).alias("kind"), F.lit(a.column).alias("column"),
            F.lit(", ".join(f"{k}={v}" for k, v in sorted(a.options.items()))).alias("options"),
            F.col(f"a{i}").alias("affected"), F.col(f"l{i}").alias("lost"))
            for i, a in enumerate(single)]))))
    return reduce(DataFrame.unionByName, parts)


def lost_sample(df: DataFrame, a: Action, tokens=MISSING, limit: int = 5) -> DataFrame:
    """A few of the values (or rows) an action destroys."""
    if a.kind == "drop_duplicates":
        copies = full_row_counts(df).where("copies > 1")
        return copies.select(F.to_json(F.struct("*")).alias("value")).orderBy("value").limit(limit)
    if a.kind == "convert_type":
        c = F.col(f"`{a.column}`")
        return df.where(lost_value(c, a.options, tokens)).select(c.alias("value")).distinct().orderBy(
            "value").limit(limit)
    raise Refused("NOTHING_LOST", a.kind)


# --- proposing -----------------------------------------------------------------------------------

# What a number cast can read at all; text that fails this is not cast, which is far cheaper than a
# cast that fails.
CASTABLE = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def _as_number(text: Column, kind: str = "double") -> Column:
    return F.when(text.rlike(CASTABLE), text).try_cast(kind)


def _share(cond: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(name)


def _number_shares(h: DataFrame) -> DataFrame:
    """How many values read as numbers under each reading, and with what precision."""
    v = F.col("v")
    bare = F.regexp_replace(v, CURRENCY, "")
    read = h.select("column", "n", _as_number(v).alias("d"), _as_number(v, "decimal(18,2)").alias("cents"),
                    _as_number(bare).alias("money"), _as_number(bare, "decimal(18,2)").alias("m_cents"),
                    *[_as_number(number_text(v, r)).alias(f"x_{r}") for r in ("us", "eu", "percent")])
    d, money = F.col("d"), F.col("money")

    def off(x: Column, exact: Column) -> Column:
        return x.isNotNull() & (exact.isNull() | (exact.cast("double") != x))

    exprs = [_share(d.isNotNull(), "double"), _share(d.isNotNull() & (d != F.floor(d)), "fraction"),
             _share(off(d, F.col("cents")), "off_cents"), _share(money.isNotNull(), "money"),
             _share(off(money, F.col("m_cents")), "money_off")]
    for reading in ("us", "eu", "percent"):
        x = F.col(f"x_{reading}")
        exprs += [_share(x.isNotNull() & (x != F.floor(x)), f"frac_{reading}"),
                  _share(x.isNotNull() & (F.round(x, 2) != x), f"off_{reading}")]
    return read.groupBy("column").agg(*exprs)


def _date_shares(h: DataFrame) -> DataFrame:
    """How many values read as dates by a plain cast, and by the formats in either numeric order."""
    v, t = F.col("v"), F.trim("v")
    read = h.select("column", "n", F.when(v.rlike(DATE_SHAPE), t).try_cast("timestamp_ntz").alias("stamp"),
                    _parsed(t, GENERAL).alias("general"), _parsed(t, DAY_FIRST).alias("day"),
                    _parsed(t, MONTH_FIRST).alias("month"))
    general = F.col("general")
    readings = {"none": general, "day": F.coalesce("day", general), "month": F.coalesce("month", general)}

    def timed(ts: Column) -> Column:
        return ts.isNotNull() & (ts != F.date_trunc("day", ts).cast("timestamp_ntz"))

    exprs = [_share(F.col("stamp").isNotNull(), "stamp"), _share(timed(F.col("stamp")), "timed")]
    for order, ts in readings.items():
        exprs += [_share(ts.isNotNull(), f"dates_{order}"), _share(timed(ts), f"dates_timed_{order}")]
    return read.groupBy("column").agg(*exprs)


def _shape_shares(h: DataFrame) -> DataFrame:
    """How many values have each written form."""
    v, t = F.col("v"), F.trim("v")
    read = h.select("column", "v", "n", t.alias("t"), accounting(v).alias("a"))
    a, t = F.col("a"), F.col("t")
    read = read.select("column", "v", "n", "t", a.rlike(US_NUMBER).alias("us"), a.rlike(EU_NUMBER).alias("eu"),
                       a.rlike(PERCENT).alias("percent"),
                       *[F.regexp_extract(t, NUMERIC_DATE, i).try_cast("int").alias(f"p{i}") for i in (1, 2)])
    us, eu = F.col("us"), F.col("eu")
    return read.groupBy("column").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), _share(v.rlike(LEADING_ZERO), "padded"),
        _share(F.upper(t).isin(*BOOLEAN_WORDS), "boolean"), _share(F.col("percent"), "percent"),
        _share(us, "us"), _share(eu, "eu"), _share(us & ~eu, "only_us"), _share(eu & ~us, "only_eu"),
        _share(v.rlike("[₹$€£¥,]"), "marked"), _share(t.rlike(r"^\d+$"), "digits"),
        _share(F.col("p1") > 12, "day_first"), _share(F.col("p2") > 12, "month_first"),
        _share(F.upper(t).isin(*MISSING), "missing"), _share(v != t, "untrimmed"))


def _readings(h: DataFrame) -> DataFrame:
    """Every share a proposal decides on, over (column, v, n): one row per text column.

    Three aggregates instead of one: each compiles to code small enough to be optimised, and the
    rows they are joined on are the columns of the table.
    """
    return _shape_shares(h).join(_number_shares(h), "column").join(_date_shares(h), "column")


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, v`` of the text columns' values."""
    rows = df.select(*[F.col(f"`{c}`") for c in columns]).unpivot([], columns, "column", "v")
    return rows.where(F.col("v").isNotNull())


def histograms(df: DataFrame, columns: list[str], short: int = SHORT) -> DataFrame:
    """``column, v, n`` of every text column: a value of up to ``short`` characters once, a longer one row by row.

    Short values are counted from one scan and staged. Longer ones are neither moved nor staged: the columns that hold
    any are read again where the result is used. How a value is judged does not depend on its length.
    """
    brief = F.when(F.length("v") <= short, F.col("v"))
    counted = spread(stage(_cells(df, columns).groupBy("column", brief.alias("v")).agg(F.count("*").alias("n"))))
    out = counted.where(F.col("v").isNotNull())
    # at most one row per column
    long = sorted(r["column"] for r in counted.where(F.col("v").isNull()).select("column").collect())
    if long:
        out = out.unionByName(_cells(df, long).where(F.length("v") > short).withColumn("n", F.lit(1).cast("long")))
    return out


def _name(text: Column) -> Column:
    """What stands for a text where texts are told apart: itself if short, else its digest and length, too long to be a short text."""
    return F.when(F.length(text) <= SHORT, text).otherwise(F.concat(F.md5(text), F.lpad(F.length(text).cast("string"), SHORT, "0")))


def _number_type(fraction: int, off_cents: int) -> str:
    return "bigint" if not fraction else "double" if off_cents else "decimal(18,2)"


def _conversions(r) -> list[dict]:
    """The readings a text column supports, from its counted shares."""
    total = r["total"]
    if not total:
        return []

    def reaches(name: str) -> bool:
        return r[name] / total >= MIN_SHARE

    order = ("day" if r["day_first"] and not r["month_first"]
             else "month" if r["month_first"] and not r["day_first"] else "none")
    dates = f"dates_{order}"
    dated = None
    if not reaches("digits") and reaches(dates):
        dated = {"to": "timestamp" if r[f"dates_timed_{order}"] else "date", "reading": "dates",
                 "order": None if order == "none" else order}
    if reaches("boolean") and r["boolean"] == total:
        return [{"to": "boolean"}]
    if not r["padded"] and reaches("double"):
        return [{"to": _number_type(r["fraction"], r["off_cents"])}]
    if reaches("stamp") and (dated is None or r["stamp"] >= r[dates]):
        return [{"to": "timestamp" if r["timed"] else "date"}]
    if dated:
        return [dated]
    if r["padded"]:
        return []
    if reaches("percent"):
        return [{"to": _number_type(r["frac_percent"], r["off_percent"]), "reading": "percent"}]
    us, eu = reaches("us"), reaches("eu")
    if us or eu:
        if us and r["only_us"] and not r["only_eu"]:
            kinds = ["us"]
        elif eu and r["only_eu"] and not r["only_us"]:
            kinds = ["eu"]
        elif us and eu and not (r["only_us"] or r["only_eu"]):
            kinds = ["us", "eu"]      # which one is meant is the person's to say
        else:
            kinds = []
        if kinds:
            return [{"to": _number_type(r[f"frac_{k}"], r[f"off_{k}"]), "reading": k} for k in kinds]
    if r["marked"] and reaches("money"):
        return [{"to": "double" if r["money_off"] else "decimal(18,2)", "reading": "currency"}]
    return []


def _may_hold_headers(df: DataFrame, hist: DataFrame | None) -> bool:
    """Whether enough columns hold their own name as a value; read from the value counts."""
    if hist is None:
        return True
    v, name = F.lower(F.trim("v")), F.lower("column")
    own = hist.where((v == name) | (v == F.replace(name, F.lit("_"), F.lit(" ")))).select("column").distinct()
    typed = len(df.columns) - len(text_columns(df))
    return own.count() + typed >= max(2, (len(df.columns) + 1) // 2)


def _detect(df: DataFrame, tokens, hist: DataFrame | None, columns: list[str]) -> list[Action]:
    out = []
    if prof_duplicates(df).first()["duplicates"]:
        out.append(Action("drop_duplicates"))
    if len(df.columns) >= 2 and _may_hold_headers(df, hist) and not df.where(header_row(df)).isEmpty():
        out.append(Action("drop_header_rows"))
    shares, merged = {}, set()
    if hist is not None:
        # one row per text column
        shares = {r["column"]: r for r in _readings(hist).collect()}
        # two hashes of 96 bits tell the values of a folded one apart, in buffers of fixed size
        folded = hist.groupBy("column", _name(F.upper("v"))).agg(*[f(h("v")).alias(f"{f.__name__}_{h.__name__}") for h in (F.xxhash64, F.hash) for f in (F.min, F.max)])
        several = folded.where("min_xxhash64 <> max_xxhash64 OR min_hash <> max_hash")
        merged = {r[0] for r in several.select("column").distinct().collect()}
    for c in columns:
        r = shares.get(c)
        if r is None:
            continue
        out += [Action("convert_type", c, {k: v for k, v in o.items() if v}) for o in _conversions(r)]
        if tokens and r["missing"]:
            out.append(Action("normalise_missing", c))
        if r["untrimmed"]:
            out.append(Action("trim", c))
        if c in merged:
            out.append(Action("case", c, {"mode": "upper"}))
    floats = [c for c in countable(df) if is_kind(df, c, FLOATING)]
    if floats:
        bad = df.agg(*[F.count_if(F.isnan(f"`{c}`") | (F.abs(f"`{c}`") == float("inf")))
                       for c in floats]).first()
        out += [Action("non_finite", c) for c, n in zip(floats, bad, strict=True) if n]
    return out


def _staged_histograms(df: DataFrame) -> tuple[DataFrame | None, list[str]]:
    columns = text_columns(df)
    return (histograms(df, columns) if columns else None), columns


def detect(df: DataFrame, tokens=MISSING) -> list[Action]:
    """Every action the table supports, table-level first, then in column order."""
    hist, columns = _staged_histograms(df)
    return _detect(df, tokens, hist, columns)


def cln_detect(df: DataFrame, tokens=MISSING) -> DataFrame:
    """The plan: one row per action with the rows it affects and what it loses.

    The table is scanned once for all its short text values; readings and losses come from the staged
    value counts, and from long values where they are read.
    """
    hist, columns = _staged_histograms(df)
    actions = _detect(df, tokens, hist, columns)
    if not actions:
        return df.sparkSession.createDataFrame(
            [], "id string, kind string, column string, options string, affected long, lost long")
    return _impacts(df, actions, tokens, hist)


def conflicts(actions: list[Action]) -> list[str]:
    """Why a set of actions cannot run together."""
    out = []
    owner: dict[str, Action] = {}
    for a in actions:
        if a.kind == "convert_type":
            if a.column in owner:
                out.append(f"{owner[a.column].id} and {a.id} are two readings of {a.column}")
            owner.setdefault(a.column, a)
    for a in actions:
        if a.kind != "convert_type" and a.column in owner:
            out.append(f"{a.id} and {owner[a.column].id} both change {a.column}")
    return out


def cln_apply(df: DataFrame, approved: list[Action], tokens=MISSING) -> DataFrame:
    """The approved actions in order, all or none; nothing is computed until the result is used."""
    clash = conflicts(approved)
    if clash:
        raise Refused("CONFLICTING_ACTIONS", "; ".join(clash))
    return reduce(lambda d, a: apply_one(d, a, tokens), approved, df)


def ledger(df: DataFrame, approved: list[Action], tokens=MISSING) -> DataFrame:
    """What each approved action did, measured on the table it met."""
    rows, seen = [], df
    for i, a in enumerate(approved):
        rows.append(impact(seen, a, tokens).withColumn("step", F.lit(i + 1)))
        seen = apply_one(seen, a, tokens)
    return reduce(DataFrame.unionByName, rows)


def cln_apply_version(spark: SparkSession, path: str, approved: list[Action], tokens=MISSING, note: str = "") -> int:
    """The approved actions on the last version of the table at ``path``, committed as the next one; returns its number.

    All or none: the new version is there once its rows and its ledger are. The version before it stays readable, and
    ``versions.undo`` leads back to it.
    """
    if not approved:
        raise Refused("NOTHING_APPROVED", path)
    parent = versions.manifest(spark, path)["version"]
    before = versions.read(spark, path, parent)
    return versions.commit(cln_apply(before, approved, tokens), path, "clean", note, counted_ledger(before, approved, tokens), parent)


#: Actions that leave out rows.
_DROPPING = ("drop_duplicates", "drop_header_rows")


def counted_ledger(df: DataFrame, approved: list[Action], tokens=MISSING) -> DataFrame:
    """``ledger`` with the rows before and after each action; only actions that leave out rows are counted again."""
    seen, n, counts = df, df.count(), []
    for i, a in enumerate(approved):
        seen, was = apply_one(seen, a, tokens), n
        n = seen.count() if a.kind in _DROPPING else n
        counts.append((i + 1, was, n))
    rows = df.sparkSession.createDataFrame(counts, "step int, rows_before long, rows_after long")
    return ledger(df, approved, tokens).join(F.broadcast(rows), "step")
