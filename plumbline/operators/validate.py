"""Checks of a table against its contract: every row passed, failed or was not checked.

Each check returns one row: check, subject, rows, passed, failed, not_checked, examples.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import Contract, ForeignKey, as_date
from .scope import checked_predicate, in_window

EXAMPLES = 10


def _result(counts: DataFrame, check: str, subject: str, examples: DataFrame | None = None) -> DataFrame:
    """``counts`` has rows, failed, not_checked; ``examples`` a text column of at most ten rows."""
    text = F.lit("")
    if examples is not None:
        few = examples.limit(EXAMPLES).agg(
            F.array_join(F.array_sort(F.collect_list("example")), " | "))
        text = F.coalesce(few.scalar(), F.lit(""))
    rows, failed, skipped = (F.coalesce(F.col(c), F.lit(0)).cast("long")
                             for c in ("rows", "failed", "not_checked"))
    return counts.select(F.lit(check).alias("check"), F.lit(subject).alias("subject"),
                         rows.alias("rows"), (rows - failed - skipped).alias("passed"),
                         failed.alias("failed"), skipped.alias("not_checked"), text.alias("examples"))


def _shown(columns: list[str]) -> Column:
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"),
                                                                   F.lit("NULL"))) for c in columns])


def _first(df: DataFrame, columns: list[str]) -> DataFrame:
    """The first few by key, found without sorting the rest."""
    return df.select(*columns).orderBy(*[F.asc_nulls_last(c) for c in columns]).limit(
        EXAMPLES).select(_shown(columns).alias("example"))


def val_key_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key repeats; a single-column key leaves its NULLs unchecked."""
    groups = df.groupBy(*key).agg(F.count("*").alias("__n"))
    null = F.col(key[0]).isNull() if len(key) == 1 else F.lit(False)
    n = F.col("__n")
    counts = groups.agg(F.sum("__n").alias("rows"),
                        F.sum(F.when((n > 1) & ~null, n)).alias("failed"),
                        F.sum(F.when(null, n)).alias("not_checked"))
    return _result(counts, "key.unique", " + ".join(key), _first(groups.where((n > 1) & ~null), key))


def val_key_complete(df: DataFrame, key: list[str]) -> DataFrame:
    gone = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    counts = df.agg(F.count("*").alias("rows"), F.count_if(gone).alias("failed"),
                    F.lit(0).alias("not_checked"))
    return _result(counts, "key.complete", " + ".join(key))


def val_date_present(df: DataFrame, column: str) -> DataFrame:
    counts = df.agg(F.count("*").alias("rows"), F.count_if(F.col(column).isNull()).alias("failed"),
                    F.lit(0).alias("not_checked"))
    return _result(counts, "date.present", column)


def val_date_in_window(df: DataFrame, column: str, start, end) -> DataFrame:
    c = F.col(column)
    inside = in_window(column, as_date(start), as_date(end))
    counts = df.agg(F.count("*").alias("rows"), F.count_if(~inside).alias("failed"),
                    F.count_if(c.isNull()).alias("not_checked"))
    return _result(counts, "date.in_window", column)


def val_date_not_future(df: DataFrame, column: str, today: str | dt.date) -> DataFrame:
    c = F.col(column)
    counts = df.agg(F.count("*").alias("rows"),
                    F.count_if(c.cast("date") > F.lit(as_date(today))).alias("failed"),
                    F.count_if(c.isNull()).alias("not_checked"))
    return _result(counts, "date.not_future", column)


def val_row_count(df: DataFrame, expected: int) -> DataFrame:
    """Growth passes, loss fails; a finding about the table, so no row passes or fails by itself."""
    n = F.count("*")
    return df.agg(F.lit("table.row_count").alias("check"), F.lit(str(expected)).alias("subject"),
                  n.alias("rows"), F.when(n >= expected, n).otherwise(0).alias("passed"),
                  F.when(n < expected, n).otherwise(0).alias("failed"),
                  F.lit(0).cast("long").alias("not_checked"), F.lit("").alias("examples"))


def val_reference(df: DataFrame, parent: DataFrame, key: ForeignKey, show: list[str] | None = None
                  ) -> DataFrame:
    """Rows pointing at no parent; a row with a NULL part is not checked.

    References and parents are grouped together, so nothing is joined or sorted and a hot reference is one row. Where their
    types differ, they are compared as a join compares them.
    """
    cols = list(key.columns)
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    if [df.schema[c].dataType for c in cols] == [parent.schema[p].dataType for p in key.parent_columns]:
        child = df.select(*cols, F.lit(1).cast("long").alias("__n"), F.lit(False).alias("__known"))
        known = parent.select(*[F.col(p).alias(c) for p, c in zip(key.parent_columns, cols, strict=True)],
                              F.lit(0).cast("long").alias("__n"), F.lit(True).alias("__known"))
        refs = child.unionAll(known).groupBy(*cols).agg(F.sum("__n").alias("__n"), F.max("__known").alias("__known")).where("__n > 0")
    else:
        refs = df.groupBy(*cols).agg(F.count("*").alias("__n"))
        parents = parent.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(key.parent_columns)]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(cols)])
        # several parents may equal one reference after a cast, so they only mark it
        refs = (refs.join(parents, same, "left_semi").withColumn("__known", F.lit(True))
                .unionAll(refs.join(parents, same, "left_anti").withColumn("__known", F.lit(False))))
    lost = refs.where(~null & ~F.col("__known"))
    counts = refs.agg(F.sum("__n").alias("rows"), F.sum(F.when(null, F.col("__n"))).alias("not_checked"),
                      F.coalesce(F.sum(F.when(~null & ~F.col("__known"), F.col("__n"))), F.lit(0)).alias("failed"))
    return _result(counts, "reference", f"{' + '.join(cols)} -> {key.parent}", _first(lost, show or cols))


def val_domain(df: DataFrame, column: str, accepted: list) -> DataFrame:
    values = df.groupBy(column).agg(F.count("*").alias("__n"))
    outside = F.col(column).isNotNull() & ~F.col(column).isin(*accepted)
    counts = values.agg(F.sum("__n").alias("rows"), F.sum(F.when(outside, F.col("__n"))).alias("failed"),
                        F.sum(F.when(F.col(column).isNull(), F.col("__n"))).alias("not_checked"))
    return _result(counts, "domain", column, _first(values.where(outside), [column]))


def val_expectation(df: DataFrame, rule: str, key: list[str] = ()) -> DataFrame:
    """Rule false fails, rule NULL is not checked."""
    cond = checked_predicate(df, rule)
    counts = df.agg(F.count("*").alias("rows"), F.count_if(~cond).alias("failed"),
                    F.count_if(cond.isNull()).alias("not_checked"))
    shown = _first(df.where(~cond), list(key)) if key else None
    return _result(counts, "expectation", rule, shown)


def _row_checks(df: DataFrame, checks: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """Checks that look at one row at a time, all in one scan: (check, subject, fails, unchecked)."""
    aggs = [F.count("*").alias("n")]
    for i, (_, _, fails, skipped) in enumerate(checks):
        aggs += [F.count_if(fails).alias(f"f{i}"), F.count_if(skipped).alias(f"s{i}")]
    n = F.col("n")
    return df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(check).alias("check"), F.lit(subject).alias("subject"), n.alias("rows"),
                 (n - F.col(f"f{i}") - F.col(f"s{i}")).alias("passed"), F.col(f"f{i}").alias("failed"),
                 F.col(f"s{i}").alias("not_checked"), F.lit("").alias("examples"))
        for i, (check, subject, _, _) in enumerate(checks)])))


def val_report(df: DataFrame, contract: Contract, today: str | dt.date,
               parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """Every check the contract declares, one row each."""
    never = F.lit(False)
    single, grouped = [], []
    key = list(contract.key)
    if key:
        grouped.append(val_key_unique(df, key))
        gone = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
        single.append(("key.complete", " + ".join(key), gone, never))
    c = contract.date_column
    if c:
        d, null = F.col(c), F.col(c).isNull()
        single += [("date.present", c, null, never),
                   ("date.not_future", c, d.cast("date") > F.lit(as_date(today)), null)]
        if contract.window:
            single.append(("date.in_window", c, ~in_window(c, contract.window.start, contract.window.end), null))
    if contract.row_count is not None:
        grouped.append(val_row_count(df, contract.row_count))
    grouped += [val_reference(df, parents[fk.parent], fk) for fk in contract.foreign_keys]
    grouped += [val_domain(df, col, list(v)) for col, v in contract.domains.items()]
    for e in contract.expectations:
        if key:
            grouped.append(val_expectation(df, e.rule, key))
        else:
            cond = checked_predicate(df, e.rule)
            single.append(("expectation", e.rule, ~cond, cond.isNull()))
    parts = ([_row_checks(df, single)] if single else []) + grouped
    return reduce(DataFrame.unionByName, parts)
