"""Which rows an analysis sees, and where the others went.

A ``Scope`` is a lazy DataFrame plus its contract. Narrowing returns a new Scope; nothing runs
until a result is asked for, except the checks that exist to refuse a question.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import Contract, Measure
from ..errors import Refused
from ..functions.aggs import NUMERIC, TEMPORAL, finite, is_kind, text_of


def checked_predicate(df: DataFrame, rule: str) -> Column:
    """A caller's rule as a Column, refused unless it is one boolean expression over the table."""
    if re.search(r";|--|/\*|\b(select|from|insert|drop)\b", rule, re.I):
        raise Refused("BAD_RULE", f"{rule!r} is not a plain condition")
    try:
        expr = F.expr(rule)
        kind = df.select(expr.alias("rule")).schema["rule"].dataType
    except PySparkException as exc:
        raise Refused("BAD_RULE", f"{rule!r} does not bind: {exc.getErrorClass()}") from None
    if not isinstance(kind, T.BooleanType):
        raise Refused("BAD_RULE", f"{rule!r} is {kind.simpleString()}, not a condition")
    return expr


def in_window(column: str, start, end) -> Column:
    """Inclusive on both ends; safe on timestamps because the end is the next day, exclusive."""
    c = F.col(column)
    return (c >= F.lit(start)) & (c < F.date_add(F.lit(end), 1))


def compared(df: DataFrame, m: Measure) -> Column:
    """1 where the comparison holds, 0 where not, NULL where a side is NULL."""
    left, op, right = m.compare
    sides = [left] + ([right] if isinstance(right, str) else [])
    for s in sides:
        if s not in df.columns:
            raise Refused("NO_SUCH_COLUMN", f"{m.name} compares {s}, which the table does not have")
    kinds = {"number" if is_kind(df, s, NUMERIC) else "date" if is_kind(df, s, TEMPORAL) else "other"
             for s in sides}
    if not isinstance(right, str):
        kinds.add("number")
    if len(kinds) != 1 or "other" in kinds:
        raise Refused("UNLIKE_SIDES", f"{m.name} must compare numbers with numbers, dates with dates")
    a = F.col(left)
    b = F.col(right) if isinstance(right, str) else F.lit(float(right))
    ops = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b, "<>": a != b}
    if op not in ops:
        raise Refused("BAD_OPERATOR", f"{op!r}")
    return ops[op].cast("int")


def _summed(terms) -> Column:
    parts = [-F.col(t[1:]) if t.startswith("-") else F.col(t) for t in terms]
    return reduce(lambda a, b: a + b, parts)


def with_measures(df: DataFrame, contract: Contract) -> DataFrame:
    """The table with its declared measures as columns."""
    extra = {}
    for m in contract.measures:
        source = m.column or m.name
        if m.compare:
            extra[m.name] = compared(df, m)
        elif m.agg == "ratio":
            extra[m.name] = F.struct((F.lit(float(m.scale)) * _summed(m.numerator)).alias("n"),
                                     _summed(m.denominator).cast("double").alias("d"))
        elif m.agg == "weighted_mean":
            # a row without a value or a weight takes no part; one with weight 0 has no say
            x, w = finite(df, source).cast("double"), finite(df, m.weight).cast("double")
            extra[m.name] = F.struct((x * w).alias("n"), F.when(x.isNotNull(), w).alias("d"))
        elif source in df.columns and is_kind(df, source, T.BooleanType):
            extra[m.name] = F.col(source).cast("int")
        elif m.column and m.column != m.name:
            extra[m.name] = F.col(m.column)
    return df.withColumns(extra) if extra else df


@dataclass(frozen=True)
class Scope:
    df: DataFrame
    contract: Contract

    @classmethod
    def of(cls, table: DataFrame, contract: Contract) -> "Scope":
        """Rows the contract keeps: not excluded, inside the window."""
        df = table
        keep = []
        for ex in contract.exclusions:
            rule = checked_predicate(df, ex.rule)
            keep.append(~F.coalesce(rule, F.lit(False)))
        if contract.window and contract.date_column:
            keep.append(in_window(contract.date_column, contract.window.start, contract.window.end))
        if keep:
            df = df.where(reduce(lambda a, b: a & b, keep))
        return cls(with_measures(df, contract), contract)

    def where(self, rule: str) -> "Scope":
        """A caller's filter: NULL leaves the row out; keeping nothing is a refusal."""
        cond = F.coalesce(checked_predicate(self.df, rule), F.lit(False))
        kept = self.df.where(cond)
        if kept.isEmpty():
            raise Refused("FILTER_KEEPS_NOTHING", rule)
        return replace(self, df=kept)

    def groups(self, dimension: str, members) -> "Scope":
        """Only the named members, compared as text."""
        self.contract.dimension(dimension)
        wanted = sorted({str(m) for m in members})
        if not wanted:
            raise Refused("NO_MEMBERS", "name the members to keep")
        kept = self.df.where(text_of(dimension).isin(wanted))
        # at most len(wanted) rows come back
        present = {r[0] for r in kept.select(text_of(dimension)).distinct().collect()}
        missing = [m for m in wanted if m not in present]
        if missing:
            raise Refused("UNKNOWN_MEMBER", f"no row has {dimension} {', '.join(missing)}")
        return replace(self, df=kept)

    def period(self, label: str, grain: str = "month") -> "Scope":
        """Only the rows of one calendar period."""
        from .periods import label_start, trunc_to
        start = label_start(label, grain)
        c = self.contract.require_date()
        if self.contract.window:
            w = self.contract.window
            if not (label_start(w.start, grain) <= start <= w.end):
                raise Refused("UNKNOWN_PERIOD", f"{label} is not in the window")
        return replace(self, df=self.df.where(trunc_to(grain, F.col(c)) == F.lit(start)))

    def units(self, measures: list[str], columns: list[str] = (), optional: list[str] = (),
              date: bool = False) -> "Scope":
        """One row per unit of the measures' ``per``; a column varying inside a unit is refused."""
        declared = [self.contract.measure(m) for m in measures]
        per = list(declared[0].per)
        if any(list(m.per) != per for m in declared):
            raise Refused("MIXED_UNITS", "the measures belong to different units")
        needed = [c for c in dict.fromkeys(columns) if c not in per]
        if date and self.contract.date_column not in [*per, *needed]:
            needed.append(self.contract.require_date())
        extra = [c for c in optional if c not in per and c not in needed]
        checked = [*needed, *extra, *measures]
        varying = unit_violations(self.df, per, checked)
        for c in [*needed, *measures]:
            if varying[c]:
                raise Refused("VARIES_WITHIN_UNIT",
                              f"{c} varies within {' + '.join(per)} ({varying[c]} unit(s))")
        kept = [c for c in extra if not varying[c]]
        return replace(self, df=self.df.select(*per, *needed, *kept, *measures).distinct())

    def for_measure(self, measure: str, columns: list[str] = (), date: bool = False) -> "Scope":
        """The scope a measure is read at: rows, or units when it is declared per unit."""
        m = self.contract.measure(measure)
        return self.units([measure], columns, date=date) if m.per else self


def unit_violations(df: DataFrame, per: list[str], columns: list[str]) -> dict[str, int]:
    """Units holding more than one value of each column, in one pass.

    min <> max instead of count(distinct): it pre-aggregates on the map side and needs no Expand.
    """
    g = df.groupBy(*per).agg(*[(F.min(c) != F.max(c)).alias(f"v{i}")
                               for i, c in enumerate(columns)])
    row = g.agg(*[F.count_if(f"v{i}").alias(f"v{i}") for i in range(len(columns))]).first()
    return {c: int(row[i]) for i, c in enumerate(columns)}


def scope_counts(table: DataFrame, contract: Contract) -> DataFrame:
    """One row: every row of the table in exactly one bucket, from a single scan."""
    rules = [checked_predicate(table, e.rule) for e in contract.exclusions]
    excluded = F.lit(False)
    unknown = F.lit(False)
    for r in rules:
        excluded = excluded | F.coalesce(r, F.lit(False))
        unknown = unknown | r.isNull()
    if contract.window and contract.date_column:
        inside = in_window(contract.date_column, contract.window.start, contract.window.end)
    else:
        inside = F.lit(True)
    kept = ~excluded
    return table.agg(
        F.count("*").alias("rows"),
        F.count_if(excluded).alias("excluded"),
        F.count_if(kept & ~inside).alias("outside_window"),
        F.count_if(kept & inside.isNull()).alias("no_date"),
        F.count_if(kept & inside).alias("analysed"),
        F.count_if(kept & unknown).alias("rule_unknown"),
    )


def derived_measures(table: DataFrame, contract: Contract, columns: list[str]) -> DataFrame:
    """The named columns with the derived measures beside them."""
    return with_measures(table, contract).select(*columns)
