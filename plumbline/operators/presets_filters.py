"""Declarative row filters, flags and value matching used by presets."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import as_date
from ..errors import Refused
from ..functions.aggs import is_kind, text_of
from .scope import Scope, checked_predicate


def _day(column: str) -> Column:
    return F.col(column).cast("date")


def _matches(column: str, pattern: str) -> Column:
    return F.coalesce(F.lower(text_of(column)).rlike(pattern.lower()), F.lit(False))


def truthy(df: DataFrame, column: str) -> Column:
    """Yes in any of the ways a flag column writes it."""
    if is_kind(df, column, T.BooleanType):
        return F.coalesce(F.col(column), F.lit(False))
    return F.lower(F.trim(text_of(column))).isin("1", "true", "t", "yes", "y")


def condition(df: DataFrame, kind: str, a: dict) -> Column:
    """One filter step as the condition a kept row meets."""
    if kind == "exclude_matching":
        return ~_matches(a["column"], a["pattern"])
    if kind == "keep_matching":
        return _matches(a["column"], a["pattern"])
    if kind == "require_positive":
        return F.col(a["column"]) > 0
    if kind == "require_after":
        return _day(a["column"]) > F.lit(as_date(a["date"]))
    if kind == "exclude_truthy":
        return ~F.coalesce(truthy(df, a["column"]), F.lit(False))
    if kind == "between":
        return F.col(a["column"]).between(a["low"], a["high"])
    if kind == "date_range":
        return _day(a["column"]).between(F.lit(as_date(a["start"])), F.lit(as_date(a["end"])))
    if kind == "compare":
        x, y = F.col(a["left"]), F.col(a["right"])
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "=": x == y, "<>": x != y}[a["op"]]
    if kind == "older_than":
        limit = as_date(a["as_of"]) - dt.timedelta(days=int(a["days"]))
        return _day(a["column"]) <= F.lit(limit)
    if kind == "terms":
        terms = [t.strip().lower() for t in a["terms"] if t.strip()]
        hit = reduce(lambda p, q: p | q,
                     [F.contains(F.lower(text_of(a["column"])), F.lit(t)) for t in terms], F.lit(False))
        hit = F.coalesce(hit, F.lit(False))
        return ~hit if a.get("negate") else hit
    if kind == "where":
        return F.coalesce(checked_predicate(df, a["rule"]), F.lit(False))
    raise Refused("UNKNOWN_FILTER", kind)


def filtered(df: DataFrame, steps: list[dict]) -> DataFrame:
    for step in steps:
        (kind, args), = step.items()
        df = df.where(condition(df, kind, args))
    return df


def flags(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows each rule points at; nothing is dropped. One scan for all rules."""
    named = []
    for rule in rules:
        (kind, arg), = rule.items()
        if kind == "flag_zero":
            named.append((f"flag_zero:{arg}", F.col(arg) == 0))
        elif kind == "flag_rows":
            named.append((f"flag_rows:{arg}", checked_predicate(df, arg)))
        else:
            raise Refused("UNKNOWN_FLAG", kind)
    wide = df.agg(F.count("*").alias("rows"),
                  *[F.count_if(c).alias(f"f{i}") for i, (_, c) in enumerate(named)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("flag"), F.col(f"f{i}").alias("n"), F.col("rows"))
        for i, (n, _) in enumerate(named)])))


def canonical(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "")


def match_values(df: DataFrame, column: str, typed: list[str], aliases: dict[str, str]
                 ) -> DataFrame:
    """What a person typed -> the value the column holds.

    In order: exact, equal after canonicalising, an alias, the only value containing it. Every
    typed text is tested against every distinct value in one aggregate: no pairs are produced.
    """
    values = df.select(text_of(column).alias("v")).where(F.col("v").isNotNull()).distinct()
    k = canonical(F.col("v"))
    aggs = []
    for i, w in enumerate(typed):
        c = canonical(F.lit(w))
        inside = F.contains(k, c)
        aggs += [F.max(F.when(F.col("v") == w, F.col("v"))).alias(f"e{i}"),
                 F.min(F.when(k == c, F.col("v"))).alias(f"c{i}"),
                 F.when(F.count_if(inside) == 1, F.min(F.when(inside, F.col("v")))).alias(f"i{i}")]
    wide = values.agg(*aggs)
    table = F.create_map(*[x for a, v in aliases.items()
                           for x in (canonical(F.lit(a)), F.lit(v))]) if aliases else None
    rows = []
    for i, w in enumerate(typed):
        alias = (F.try_element_at(table, canonical(F.lit(w))) if aliases
                 else F.lit(None).cast("string"))
        rows.append(F.struct(F.lit(w).alias("typed"),
                             F.coalesce(F.col(f"e{i}"), F.col(f"c{i}"), alias,
                                        F.col(f"i{i}")).alias("value")))
    return wide.select(F.inline(F.array(*rows)))


def focus_worst(scope: Scope, dimension: str, measure: str, min_group: int = 5) -> Scope:
    """The rows of the group with the highest mean, among groups that are large enough."""
    scope.contract.dimension(dimension)
    g = scope.df.where(F.col(dimension).isNotNull()).groupBy(dimension).agg(
        F.avg(measure).alias("m"), F.count(measure).alias("n"))
    worst = g.where(F.col("n") >= min_group).orderBy(F.desc("m"), dimension).limit(1).first()
    if worst is None:
        raise Refused("NO_GROUP_LARGE_ENOUGH", f"no {dimension} has {min_group} values")
    return Scope(scope.df.where(F.col(dimension) == F.lit(worst[0])), scope.contract)
