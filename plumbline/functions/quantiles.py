"""Exact quantiles that do not depend on a group fitting in one task.

Spark's ``percentile`` keeps one counter per distinct value of a group. That is the right tool for a
column of few distinct values, and it is only used after that number has been measured. For the
others the wanted ranks are found by counting: values fall into equal slices of the column's range,
only the slices holding a wanted rank are looked at again, and a slice that still holds too much is
sliced further. All columns and all groups go through each step together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

#: Distinct values one percentile buffer may hold.
DISTINCT_LIMIT = 20_000
#: Slices per step, rows the last step may sort, and steps after which a double has no digits left.
SLICES, SORT_ROWS, DEPTH = 2048, 5_000_000, 5
#: Slices wanted by all groups and columns up to this many are broadcast; beyond it, rows meet them by a shuffle.
BROADCAST_SLICES = 200_000


@dataclass(frozen=True)
class Facts:
    distinct: int
    low: float | None
    high: float | None


def probe(df: DataFrame, columns: list[str]) -> dict[str, Facts]:
    """Roughly how many distinct values each column has, and its range; one scan."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.approx_count_distinct(c).alias(f"d{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {c: Facts(row[f"d{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def percentile(column: str | Column, p) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    if isinstance(p, (list, tuple)):
        return F.percentile(c.cast("double"), [float(x) for x in p])
    return F.percentile(c.cast("double"), float(p))


def bucket_of(column: str, bounds: list[float]) -> Column:
    """Number of bounds below the value: a fixed expression, so it is the same on every read."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return (f"CASE WHEN `{column}` <= {bounds[mid]!r}D THEN {tree(lo, mid)} "
                f"ELSE {tree(mid + 1, hi)} END")

    return F.expr(tree(0, len(bounds)))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner"):
    """Join on ``keys`` where a NULL matches a NULL; the keys come out once."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def _slice(y: Column, slices: int) -> Column:
    """The slice of a position in [0, slices]; never falls as the position rises."""
    return F.least(F.floor(y), F.lit(slices - 1)).cast("int")


def selected(df: DataFrame, keys: list[str], quantiles: dict[str, tuple[str, float]],
             facts: dict[str, Facts], slices: int = SLICES, sort_rows: int = SORT_ROWS) -> DataFrame:
    """Interpolated quantiles per group by slice counting; one row per group.

    Each step is one scan and one aggregate of counts, which merge on the map side. Windows run over
    the counts of one group and slice: at most ``slices`` rows. Only the last step sorts values, and
    only those of slices that together hold at most ``sort_rows`` rows (or a single value).
    """
    columns = sorted({c for c, _ in quantiles.values()})
    place = {c: i for i, c in enumerate(columns)}
    cells = []
    for i, c in enumerate(columns):
        lo, hi = facts[c].low or 0.0, facts[c].high or 0.0
        scale = slices / (hi - lo) if hi > lo and math.isfinite(slices / (hi - lo)) else 0.0
        x = F.col(c).cast("double")
        cells.append(F.struct(F.lit(i).alias("__c"), x.alias("__x"),
                              ((x - F.lit(lo)) * F.lit(scale)).alias("__y")))
    if len(cells) == 1:
        rows = df.select(*keys, cells[0].alias("s")).select(*keys, "s.*")
    else:
        rows = df.select(*keys, F.inline(F.array(*cells)))
    rows = rows.where(F.col("__x").isNotNull())
    by = [*keys, "__c"]

    def at(p: float) -> Column:
        return (F.col("__total") - 1) * F.lit(float(p))

    def holds(rank: Column) -> Column:
        return (rank >= F.col("__lo")) & (rank < F.col("__hi"))

    wanted = reduce(lambda a, b: a | b, [
        (F.col("__c") == place[c]) & (holds(F.floor(at(p))) | holds(F.ceil(at(p))))
        for c, p in quantiles.values()])

    path: list[str] = []
    need = None
    while True:
        level = f"__s{len(path)}"
        rows = rows.withColumn(level, _slice(F.col("__y"), slices))
        path.append(level)
        counted = rows.groupBy(*by, *path, *([] if need is None else ["__total", "__base"])).agg(
            F.count("*").alias("__n"))
        outer = [*by, *path[:-1]]
        upto = Window.partitionBy(*outer).orderBy(level).rowsBetween(Window.unboundedPreceding,
                                                                     Window.currentRow)
        if need is None:
            counted = counted.withColumns({"__total": F.sum("__n").over(Window.partitionBy(*outer)),
                                           "__base": F.lit(0).cast("long")})
        counted = counted.withColumn("__hi", F.sum("__n").over(upto) + F.col("__base"))
        counted = counted.withColumn("__lo", F.col("__hi") - F.col("__n"))
        need = stage(counted.where(wanted).select(*by, *path, "__total", F.col("__lo").alias("__base"), "__n"))
        left, slices_wanted = need.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count("*")).first()
        # the wanted slices are few: raw rows are filtered where they are, not shuffled by slice
        side = need.drop("__n")
        side = F.broadcast(side) if slices_wanted <= BROADCAST_SLICES else side
        near = null_safe_join(rows.select(*by, *path, "__x", "__y"), side, [*by, *path])
        if left <= sort_rows or len(path) == DEPTH:
            break
        # the position inside the slice, stretched to the full number of slices; what is left is read
        # twice below, the source no more
        rows = stage(near).withColumn("__y", (F.col("__y") - F.col(level)) * F.lit(float(slices)))

    # equal values collapse before the sort, so a heavily repeated value is one row
    hist = near.groupBy(*by, *path, "__base", "__total", "__x").agg(F.count("*").alias("__k"))
    w = Window.partitionBy(*by, *path).orderBy("__x").rowsBetween(Window.unboundedPreceding,
                                                                 Window.currentRow)
    hist = hist.withColumn("__end", F.sum("__k").over(w) + F.col("__base"))
    hist = hist.withColumn("__start", F.col("__end") - F.col("__k"))

    aggs = []
    for name, (c, p) in quantiles.items():
        mine = F.col("__c") == place[c]

        def value_at(rank: Column, mine=mine) -> Column:
            return F.max(F.when(mine & (rank >= F.col("__start")) & (rank < F.col("__end")), F.col("__x")))

        aggs += [value_at(F.floor(at(p))).alias(f"__l_{name}"),
                 value_at(F.ceil(at(p))).alias(f"__h_{name}"),
                 F.max(F.when(mine, at(p) - F.floor(at(p)))).alias(f"__f_{name}")]
    got = hist.groupBy(*keys).agg(*aggs)
    return got.select(*keys, *[
        (F.col(f"__l_{n}") + F.col(f"__f_{n}") * (F.col(f"__h_{n}") - F.col(f"__l_{n}"))).alias(n)
        for n in quantiles])


def grouped(df: DataFrame, keys: list[str], aggs: list[Column],
            quantiles: dict[str, tuple[str, float]], limit: int = DISTINCT_LIMIT,
            slices: int = SLICES, sort_rows: int = SORT_ROWS) -> DataFrame:
    """``groupBy(keys).agg(aggs)`` with exact quantiles beside it: ``{alias: (column, p)}``."""
    columns = sorted({c for c, _ in quantiles.values()})
    facts = probe(df, columns)
    few = [c for c in columns if facts[c].distinct <= limit]
    # all quantiles of a column share one buffer
    arrays, picks = [], []
    for i, c in enumerate(few):
        wanted = [(a, p) for a, (col, p) in quantiles.items() if col == c]
        arrays.append(percentile(c, [p for _, p in wanted]).alias(f"__q{i}"))
        picks += [F.col(f"__q{i}")[j].alias(a) for j, (a, _) in enumerate(wanted)]
    out = df.groupBy(*keys).agg(*(aggs or [F.count("*").alias("__rows")]), *arrays)
    kept = [c for c in out.columns if not c.startswith("__q") and c != "__rows"]
    out = out.select(*kept, *picks) if kept or picks else out
    many = {a: (c, p) for a, (c, p) in quantiles.items() if c not in few}
    if many:
        part = selected(df, keys, many, facts, slices, sort_rows)
        if keys:
            out = null_safe_join(out, part, keys, "left")
        else:
            got = part.first()
            out = out.withColumns({a: F.lit(got[a] if got else None).cast("double") for a in many})
    return out.drop("__rows")
