"""Findings a person should know before reading a number: each rule returns finding rows.

A finding is ``rule, column, rows, detail``. Rules over many columns share one scan.
"""

from __future__ import annotations

import datetime as dt
import itertools
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import as_date

from ..functions.staging import stage
from ..functions.words import (ENTITY, PERCENT, PLACEHOLDERS, SUBTOTALS, WORDS, pii_class,
                               words_of_name)
from .periods import spine, trunc_to
from .profile import DATE_SHAPE, evidence, numeric_columns, rows_frame, text_columns
from .suggest import currency_codes

SCHEMA = "rule string, column string, rows long, detail string"


def _findings(wide: DataFrame, rule: str, named: list[tuple[str, Column, Column | None]]) -> DataFrame:
    """(column, count, detail) expressions over a one-row frame, keeping counts above zero."""
    text = F.lit(None).cast("string")
    rows = [F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column"), n.cast("long").alias("rows"),
                     (text if d is None else d.cast("string")).alias("detail")) for c, n, d in named]
    if not rows:
        return wide.sparkSession.createDataFrame([], SCHEMA)
    return wide.select(F.inline(F.array(*rows))).where(F.col("rows") > 0)


def _union(df: DataFrame, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else rows_frame(df, [], SCHEMA)


def _tokens(df: DataFrame, rule: str, tokens, columns) -> DataFrame:
    parts = []
    for c in columns or text_columns(df):
        v = F.trim(F.col(c))
        parts.append(df.where(F.lower(v).isin(*tokens)).groupBy(v.alias("detail")).agg(
            F.count("*").alias("rows")).select(F.lit(rule).alias("rule"), F.lit(c).alias("column"),
                                               "rows", "detail"))
    return _union(df, parts)


def dq_placeholder(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text standing for a missing value, per token as written."""
    return _tokens(df, "M1", PLACEHOLDERS, columns)


def dq_subtotals(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows labelled as totals: every sum over the table would count their parts twice."""
    return _tokens(df, "M6", SUBTOTALS, columns)


def blank(df: DataFrame, c: str) -> Column:
    null = F.col(c).isNull()
    if isinstance(df.schema[c].dataType, T.StringType):
        return F.coalesce(null | (F.trim(F.col(c)) == ""), F.lit(True))
    return null


def dq_blank(df: DataFrame, explain: list[str] | None = None, columns: list[str] | None = None
             ) -> DataFrame:
    """Blank columns; those blank on the same rows together; the one value that explains them."""
    columns = columns or df.columns
    marks = {f"__b{i}": blank(df, c) for i, c in enumerate(columns)}
    # one row per blank pattern: a handful, whatever the size of the table
    patterns = stage(df.select(*[m.alias(n) for n, m in marks.items()]).groupBy(*marks).agg(
        F.count("*").alias("n")))
    total = patterns.agg(F.sum("n").alias("rows"), *[
        F.coalesce(F.sum(F.when(F.col(b), F.col("n"))), F.lit(0)).alias(b) for b in marks]).first()
    live = [(c, b) for c, b in zip(columns, marks, strict=True) if 0 < total[b] < total["rows"]]
    groups: list[list[tuple[str, str]]] = []
    for n, members in itertools.groupby(sorted(live, key=lambda cb: (total[cb[1]], cb[0])),
                                        key=lambda cb: total[cb[1]]):
        members = list(members)
        together = reduce(lambda p, q: p & q, [F.col(b) for _, b in members])
        same = len(members) == 1 or patterns.where(together).agg(F.sum("n")).first()[0] == n
        groups += [members] if same else [[m] for m in members]
    out = []
    why = _explanations(df.withColumns(marks), groups, explain or [], total)
    for g, note in zip(groups, why, strict=True):
        out.append(("M2", ",".join(c for c, _ in g), total[g[0][1]], note))
    return rows_frame(df, out, SCHEMA)


def _explanations(df: DataFrame, groups, explain: list[str], total, near: float = 0.0):
    """For each blank group the dimension value holding exactly its rows (or just over them)."""
    notes: list[str | None] = [None] * len(groups)
    if not explain or not groups:
        return notes
    hits = [F.count_if(reduce(lambda p, q: p & q, [F.col(b) for _, b in g])).alias(f"h{i}")
            for i, g in enumerate(groups)]
    sets = df.groupingSets([[F.col(e)] for e in explain], *[F.col(e) for e in explain])
    which = reduce(lambda acc, e: F.when(F.grouping(e) == 0, F.lit(e)).otherwise(acc),
                   reversed(explain), F.lit(None).cast("string"))
    value = F.coalesce(*[F.col(e).cast("string") for e in explain])
    cells = sets.agg(which.alias("dim"), value.alias("value"), F.count("*").alias("n"), *hits)
    wanted = []
    for i, g in enumerate(groups):
        n = total[g[0][1]]
        extra = F.col("n") - F.lit(n)
        fits = (extra == 0) if not near else (extra > 0) & (extra <= F.lit(near * total["rows"]))
        wanted.append((F.col(f"h{i}") == n) & fits)
    # only cells that explain something come back: a few per blank group
    rows = cells.where(reduce(lambda p, q: p | q, wanted)).select(
        "dim", "value", "n", *[w.alias(f"w{i}") for i, w in enumerate(wanted)]).collect()
    for i, g in enumerate(groups):
        names = {c for c, _ in g}
        good = sorted((r["value"] is None, r["dim"], str(r["value"]), r["n"]) for r in rows
                      if r[f"w{i}"] and r["dim"] not in names)
        if good:
            _, d, v, n = good[0]
            notes[i] = f"{d} = {v}" + (f" (+{n - total[g[0][1]]})" if near else "")
    return notes


def dq_near_miss(df: DataFrame, explain: list[str], columns: list[str] | None = None) -> DataFrame:
    """Blank columns whose rows all lie in one value that holds at most 1% more rows."""
    columns = columns or df.columns
    marks = {f"__b{i}": blank(df, c) for i, c in enumerate(columns)}
    marked = df.withColumns(marks)
    total = marked.agg(F.count("*").alias("rows"), *[F.count_if(b).alias(b) for b in marks]).first()
    groups = [[(c, b)] for c, b in zip(columns, marks, strict=True) if 0 < total[b] < total["rows"]]
    exact = _explanations(marked, groups, explain, total)
    close = _explanations(marked, groups, explain, total, near=0.01)
    return rows_frame(df, [("M14", g[0][0], total[g[0][1]], note)
                           for g, note, e in zip(groups, close, exact, strict=True)
                           if note and not e], SCHEMA)


NEGATIVE_SHARE = 0.05


def dq_negative(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Values below zero: an error while rare, a signed measure when common."""
    columns = columns or numeric_columns(df)
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count_if(F.col(c) < 0).alias(f"n{i}"), F.count(c).alias(f"c{i}")]
    wide = df.agg(*aggs)
    return _findings(wide, "M3", [
        (c, F.col(f"n{i}"), F.when(F.col(f"n{i}") <= F.lit(NEGATIVE_SHARE) * F.col(f"c{i}"), "error")
         .otherwise("signed")) for i, c in enumerate(columns)])


def as_day(c: Column) -> Column:
    return F.when(c.rlike(DATE_SHAPE), c).try_cast("timestamp_ntz").cast("date")


def dq_text_dates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text where at least half but not all values read as dates; counts those that do not."""
    columns = columns or text_columns(df)
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(as_day(F.col(c))).alias(f"d{i}"), F.count(c).alias(f"c{i}")]
    wide = df.agg(*aggs)
    return _findings(wide, "M4", [
        (c, F.when(F.col(f"d{i}") >= 0.5 * F.col(f"c{i}"), F.col(f"c{i}") - F.col(f"d{i}")).otherwise(0),
         None) for i, c in enumerate(columns)])


def dq_empty_months(df: DataFrame, date_column: str, today: str | dt.date) -> DataFrame:
    """Months inside the observed span that hold no row; dates after ``today`` do not stretch it."""
    d = F.col(date_column).cast("date")
    months = stage(df.where(d <= F.lit(as_date(today))).select(
        trunc_to("month", F.col(date_column)).alias("period")).distinct())
    b = months.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).first()
    if b["lo"] is None:
        return rows_frame(df, [], SCHEMA)
    gone = spine(df.sparkSession, b["lo"], b["hi"], "month").join(months, "period", "left_anti")
    return gone.select(F.lit("M5").alias("rule"), F.lit(date_column).alias("column"),
                       F.lit(0).cast("long").alias("rows"),
                       F.date_format("period", "yyyy-MM").alias("detail"))


def dq_coordinates(df: DataFrame) -> DataFrame:
    """Latitudes and longitudes out of range, swapped, or at (0, 0)."""
    numeric = numeric_columns(df)
    lats = [c for c in numeric if words_of_name(c) & WORDS["lat"]]
    lngs = [c for c in numeric if words_of_name(c) & WORDS["lng"]
            and not words_of_name(c) & {"term", "run", "haul"}]

    def stem(c: str, kind: str) -> str:
        return re.sub("|".join(sorted(WORDS[kind], key=len, reverse=True)), "", c.lower(), count=1)

    checks: list[tuple[str, Column, str]] = []
    for c, bound in [(c, 90) for c in lats] + [(c, 180) for c in lngs]:
        checks.append((c, F.abs(F.col(c)) > bound, "out_of_range"))
    for lat in lats:
        for lng in lngs:
            if stem(lat, "lat") == stem(lng, "lng"):
                a, b = F.col(lat), F.col(lng)
                checks.append((f"{lat},{lng}", (F.abs(a) > 90) & (F.abs(a) <= 180) & (F.abs(b) <= 90),
                               "swapped"))
                checks.append((f"{lat},{lng}", (a == 0) & (b == 0), "zero"))
    if not checks:
        return rows_frame(df, [], SCHEMA)
    wide = df.agg(*[F.count_if(cond).alias(f"n{i}") for i, (_, cond, _) in enumerate(checks)])
    return _findings(wide, "M7", [(c, F.col(f"n{i}"), F.lit(kind))
                                  for i, (c, _, kind) in enumerate(checks)])


def spelling_forms(df: DataFrame, column: str) -> DataFrame:
    """k, v, n: every written form of the values that differ only in case or padding, one row each, however many."""
    per = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    forms = per.withColumn("k", F.lower(F.trim("v")))
    several = forms.groupBy("k").agg(F.count("*").alias("ways")).where("ways > 1").select("k")
    return forms.join(several, "k").select("k", "v", "n")


def dq_spellings(df: DataFrame, columns: list[str] | None = None, most: int = 50) -> DataFrame:
    """Values that differ only in case or padding, with the rows they cover.

    ``detail`` names the ``most`` frequent forms and how many more there are; ``spelling_forms`` has all.
    """
    parts = []
    for c in columns or [e.name for e in evidence(df) if e.text and e.distinct > 1]:
        forms = spelling_forms(df, c)
        nth = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "v"))
        shown = forms.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("k").agg(
            F.array_join(F.array_sort(F.collect_list("v")), " / ").alias("named"))
        folded = forms.groupBy("k").agg(F.sum("n").alias("rows"), F.count("*").alias("ways")).join(shown, "k")
        more = F.when(F.col("ways") > most, F.concat(F.lit(" / +"), F.col("ways") - most)).otherwise("")
        parts.append(folded.select(
            F.lit("M8").alias("rule"), F.lit(c).alias("column"), "rows", F.concat("named", more).alias("detail")))
    return _union(df, parts)


def dq_over_whole(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rates above 1 (or 100) where nearly every other value is not."""
    columns = columns or [c for c in numeric_columns(df) if words_of_name(c) & PERCENT]
    if not columns:
        return rows_frame(df, [], SCHEMA)
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c)
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(x > 1).alias(f"a{i}"),
                 F.count_if(x > 100).alias(f"b{i}")]
    wide = df.agg(*aggs)
    named = []
    for i, c in enumerate(columns):
        n, a, b = F.col(f"n{i}"), F.col(f"a{i}"), F.col(f"b{i}")
        fraction = (a > 0) & (n - a >= 0.99 * n)
        percent = (b > 0) & (n - b >= 0.99 * n) & (a > 0.01 * n)
        named.append((c, F.when(fraction, a).when(percent, b).otherwise(0),
                      F.when(fraction, "1").otherwise("100")))
    return _findings(wide, "M9", named)


def dq_split_id(df: DataFrame, most: int = 12) -> DataFrame:
    """Event identifiers that fall under several values of a text dimension, for at most 30%.

    A dimension has 2 to ``most`` values.
    """
    ev = evidence(df)
    dims = [c for c in ev if c.text and 2 <= c.distinct <= most and c.non_null >= 0.5 * c.rows]
    parts = []
    for c in ev:
        if not (words_of_name(c.name) & ENTITY and 1 < c.distinct < c.rows <= 3 * c.distinct):
            continue
        ds = [d for d in dims if d.name != c.name]
        if not ds:
            continue
        # min <> max says "more than one value" without a distinct set per identifier
        g = df.groupBy(F.col(c.name)).agg(*[(F.min(d.name) != F.max(d.name)).alias(f"v{i}")
                                            for i, d in enumerate(ds)])
        wide = g.agg(*[F.count_if(f"v{i}").alias(f"n{i}") for i in range(len(ds))])
        parts.append(_findings(wide, "M10", [
            (c.name, F.when(F.col(f"n{i}") <= 0.3 * c.distinct, F.col(f"n{i}")).otherwise(0),
             F.lit(d.name)) for i, d in enumerate(ds)]))
    return _union(df, parts)


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]


def dq_future(df: DataFrame, today: str | dt.date, columns: list[str] | None = None) -> DataFrame:
    columns = columns or date_columns(df)
    aggs = []
    for i, c in enumerate(columns):
        late = F.col(c).cast("date") > F.lit(as_date(today))
        aggs += [F.count_if(late).alias(f"n{i}"), F.max(F.when(late, F.col(c).cast("date"))).alias(f"m{i}")]
    return _findings(df.agg(*aggs), "M11",
                     [(c, F.col(f"n{i}"), F.col(f"m{i}")) for i, c in enumerate(columns)])


def dq_currencies(df: DataFrame) -> DataFrame:
    """Money columns beside several currency codes, unless named as converted."""
    ev = evidence(df)
    found = currency_codes(df, ev)
    if not found:
        return rows_frame(df, [], SCHEMA)
    col, codes = found
    hit = [c for c in ev if c.numeric and words_of_name(c.name) & WORDS["money"]
           and not words_of_name(c.name) & (WORDS["converted"] | WORDS["ratio"])]
    return rows_frame(df, [("M12", c.name, c.non_null, f"{col}: {', '.join(codes)}") for c in hit],
                      SCHEMA)


def dq_date_order(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairs of dates in one order on nearly every row and in the other on a few."""
    columns = columns or date_columns(df)
    pairs = list(itertools.permutations(columns, 2))
    if not pairs:
        return rows_frame(df, [], SCHEMA)
    aggs = []
    for i, (early, late) in enumerate(pairs):
        a, b = F.col(early), F.col(late)
        aggs += [F.count_if(a.isNotNull() & b.isNotNull()).alias(f"n{i}"),
                 F.count_if(a < b).alias(f"r{i}"), F.count_if(b < a).alias(f"w{i}")]
    wide = df.agg(*aggs)
    named = []
    for i, (early, late) in enumerate(pairs):
        n, r, w = F.col(f"n{i}"), F.col(f"r{i}"), F.col(f"w{i}")
        named.append((late, F.when((w <= 0.01 * n) & (r >= 0.9 * n), w).otherwise(0),
                      F.lit(f"before {early}")))
    return _findings(wide, "M13", named)


# How campaign tags write "nothing", and how a status says returned.
NOT_SET = ("(not set)", "not set", "(none)", "")
NO_MEDIUM = ("", "(not set)", "(none)")
RETURNED = "^(rto|returned|return to origin)$"


def dq_utm(df: DataFrame, source: str, medium: str) -> DataFrame:
    """Campaign tags: spellings of one source, sources not set, and rows with no medium."""
    cases = dq_spellings(df, [source]).withColumn("rule", F.lit("utm_case_variants"))
    s, m = F.lower(F.trim(F.col(source))), F.lower(F.trim(F.col(medium)))
    wide = df.agg(F.count_if(s.isin(*NOT_SET)).alias("s"),
                  F.count_if(m.isNull() | m.isin(*NO_MEDIUM)).alias("m"))
    return (cases.unionByName(_findings(wide, "utm_not_set", [(source, F.col("s"), None)]))
            .unionByName(_findings(wide, "utm_missing_medium", [(medium, F.col("m"), None)])))


def dq_flag_conflict(df: DataFrame, flag: str, status: str) -> DataFrame:
    """A return flag that disagrees with the delivery status beside it."""
    f = F.coalesce(F.lower(F.trim(F.col(flag).cast("string"))).isin("1", "true", "t", "yes", "y"),
                   F.lit(False))
    s = F.lower(F.trim(F.col(status)))
    wide = df.agg(F.count_if((s == "delivered") & f).alias("a"),
                  F.count_if(s.rlike(RETURNED) & ~f).alias("b"))
    return _findings(wide, "flag_conflict", [(flag, F.col("a"), F.lit("delivered but flagged")),
                                             (flag, F.col("b"), F.lit("returned but not flagged"))])


# How personal data written inside text looks.
PII_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
                "phone": r"\+?[0-9][0-9 ()-]{8,}[0-9]"}


def dq_pii(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns named like personal data, and text values that look like it."""
    named = [("pii_name", c, None, k) for c in df.columns if (k := pii_class(c))]
    texts = columns if columns is not None else text_columns(df)
    out = rows_frame(df, named, SCHEMA)
    if texts:
        wide = df.agg(*[F.count_if(F.col(c).rlike(p)).alias(f"n{i}_{k}")
                        for i, c in enumerate(texts) for k, p in PII_PATTERNS.items()])
        out = out.unionByName(_findings(wide, "pii_value", [
            (c, F.col(f"n{i}_{k}"), F.lit(k)) for i, c in enumerate(texts) for k in PII_PATTERNS]))
    return out


MIN_GROUP = 5


def dq_small_groups(df: DataFrame, dimension: str, value: Column, minimum: int = MIN_GROUP) -> DataFrame:
    """A value per group, suppressed where the group is too small to show."""
    g = df.groupBy(F.col(dimension).alias("member")).agg(F.count("*").alias("rows"), value.alias("v"))
    big = F.col("rows") >= minimum
    return g.select("member", F.when(big, F.col("rows")).alias("rows"),
                    F.when(big, F.col("v")).alias("value"), (~big).alias("suppressed"))


def dq_offsetting(decomposed: DataFrame, limit: float = 0.2) -> DataFrame:
    """Whether members of a decomposition move against each other and nearly cancel."""
    g = decomposed.agg(F.sum("change").alias("net"), F.sum(F.abs("change")).alias("gross"),
                       F.count_if(F.col("change") > 0).alias("rose"),
                       F.count_if(F.col("change") < 0).alias("fell"))
    against = (F.col("rose") > 0) & (F.col("fell") > 0)
    return g.withColumn("offsetting", against & (F.abs("net") <= F.lit(limit) * F.col("gross")))


def dq_context(periods: DataFrame, calendar: DataFrame) -> DataFrame:
    """Periods touching a dated event: ``periods`` (label, start, end), ``calendar`` (event, start, end).

    Both are spread over the days they cover, so the overlap is an equi-join on the day.
    """
    def days(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(name, F.explode(F.sequence("start", "end")).alias("day"))

    return days(periods, "label").join(days(calendar, "event"), "day").groupBy("label", "event").agg(
        F.count("*").alias("days"))


def all_findings(df: DataFrame, today: str | dt.date, date_column: str | None = None,
                 explain: list[str] | None = None) -> DataFrame:
    """Every rule that needs nothing beyond the table."""
    parts = [dq_placeholder(df), dq_blank(df, explain), dq_negative(df), dq_text_dates(df),
             dq_subtotals(df), dq_coordinates(df), dq_spellings(df), dq_over_whole(df),
             dq_split_id(df), dq_future(df, today), dq_currencies(df), dq_date_order(df)]
    if explain:
        parts.append(dq_near_miss(df, explain))
    if date_column:
        parts.append(dq_empty_months(df, date_column, today))
    return _union(df, parts)



