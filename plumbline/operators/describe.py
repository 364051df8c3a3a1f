"""Tier 1 and 2: what the rows look like, and which groups matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import ADDITIVE
from ..errors import Refused
from ..functions.aggs import (FLOATING, INTEGRAL, declared, finite, is_kind, non_finite_count,
                              row_values_needed, text_of, total_needed)
from ..functions.quantiles import grouped
from ..functions.staging import ranked, running, stage
from .scope import Scope, in_window

def group_totals(scope: Scope, keys: list[str], measure: str, extra: list[Column] = ()) -> DataFrame:
    """``keys, total, rows`` with the declared aggregate, medians included; groups are put in order by it, so sums are steady."""
    m = scope.contract.measure(measure)
    total_needed(m)
    aggs = [F.count("*").alias("rows"), *extra]
    if m.agg == "median":
        return grouped(scope.df, keys, aggs, {"total": (measure, 0.5)})
    floating = not m.of_sums and isinstance(scope.df.schema[m.name].dataType, FLOATING)
    return scope.df.groupBy(*keys).agg(declared(m, floating=floating).alias("total"), *aggs)


def summary_stats(scope: Scope) -> DataFrame:
    """One row per declared measure; every moment over finite values, in one wide aggregate."""
    parts = []
    plain = []
    for m in scope.contract.measures:
        if m.of_sums:
            plain.append((m, scope, "ratio"))
        elif m.per:
            plain.append((m, scope.units([m.name]), "unit"))
        else:
            plain.append((m, scope, "row"))
    shared = [(m, s) for m, s, kind in plain if kind == "row"]
    if shared:
        parts.append(_wide_stats(scope, [m for m, _ in shared]))
    for m, s, kind in plain:
        if kind == "unit":
            parts.append(_wide_stats(s, [m]))
    ratios = [m for m, _, kind in plain if kind == "ratio"]
    if ratios:
        aggs = []
        for m in ratios:
            aggs += [F.count(F.when(F.col(m.name)["n"].isNotNull() & F.col(m.name)["d"].isNotNull(),
                                    1)).alias(f"{m.name}__n"), declared(m).alias(f"{m.name}__t")]
        wide = scope.df.agg(F.count("*").alias("rows"), *aggs)
        none = F.lit(None).cast("double")
        rows = [F.struct(F.lit(m.name).alias("measure"), F.col(f"{m.name}__n").alias("n"),
                         (F.col("rows") - F.col(f"{m.name}__n")).alias("nulls"),
                         F.lit(0).cast("long").alias("non_finite"),
                         F.col(f"{m.name}__t").cast("double").alias("total"),
                         *[none.alias(k) for k in ("min", "max", "mean", "median", "stddev")])
                for m in ratios]
        parts.append(wide.select(F.inline(F.array(*rows))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _wide_stats(scope: Scope, measures) -> DataFrame:
    df = scope.df
    names = [m.name for m in measures]
    clean = df.withColumns({f"__{n}": finite(df, n).cast("double") for n in names})
    aggs = [F.count("*").alias("rows")]
    for m in measures:
        n = m.name
        x = f"__{n}"
        aggs += [F.count(n).alias(f"{n}__c"), F.count(x).alias(f"{n}__n"),
                 non_finite_count(df, n).alias(f"{n}__bad"),
                 F.min(x).alias(f"{n}__min"), F.max(x).alias(f"{n}__max"),
                 F.avg(x).alias(f"{n}__mean"), F.stddev_samp(x).alias(f"{n}__sd")]
        if m.agg in ("sum", "mean", "min", "max"):
            fn = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[m.agg]
            aggs.append(fn(x).alias(f"{n}__t"))
        elif m.agg in ("count", "count_distinct"):
            aggs.append(declared(m).alias(f"{n}__t"))
    wide = grouped(clean, [], aggs, {f"{n}__med": (f"__{n}", 0.5) for n in names})

    def total(m) -> Column:
        if m.agg == "median":
            return F.col(f"{m.name}__med")
        if m.agg in (None, "none"):
            return F.lit(None).cast("double")
        return F.col(f"{m.name}__t").cast("double")

    rows = [F.struct(F.lit(m.name).alias("measure"), F.col(f"{m.name}__n").alias("n"),
                     (F.col("rows") - F.col(f"{m.name}__c")).alias("nulls"),
                     F.col(f"{m.name}__bad").alias("non_finite"), total(m).alias("total"),
                     F.col(f"{m.name}__min").alias("min"), F.col(f"{m.name}__max").alias("max"),
                     F.col(f"{m.name}__mean").alias("mean"),
                     F.col(f"{m.name}__med").alias("median"), F.col(f"{m.name}__sd").alias("stddev"))
            for m in measures]
    return wide.select(F.inline(F.array(*rows)))


def frequency(scope: Scope, column: str, limit: int = 20) -> DataFrame:
    """Count and share per value; NULL is a value. ``tied_with_last`` counts equal groups."""
    counts = stage(scope.df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows")))
    total = counts.agg(F.sum("rows"))
    top = counts.orderBy(F.desc("rows"), F.asc_nulls_last("value")).limit(limit)
    last = top.agg(F.min("rows")).first()[0]
    ties = counts.where(F.col("rows") == F.lit(last)).count()
    return top.select("value", "rows", (F.col("rows") / total.scalar()).alias("share"),
                      F.when(F.col("rows") == F.lit(last), F.lit(ties)).cast("long")
                      .alias("tied_with_last"))


def share_basis(scope: Scope, measure: str, totals: DataFrame):
    """The number a share is a share of, or None when shares would be meaningless.

    None for an aggregate that does not add up, any group below zero, or a total of zero or less.
    """
    if scope.contract.measure(measure).agg not in ADDITIVE:
        return None
    row = totals.agg(F.sum("total").alias("s"), F.min("total").alias("lo")).first()
    if row["s"] is None or row["lo"] < 0 or row["s"] <= 0:
        return None
    return float(row["s"])


def _share(basis) -> Column:
    if basis is None:
        return F.lit(None).cast("double")
    return F.col("total") / F.lit(basis)


def _order(dimension: str = "member") -> list[Column]:
    return [F.desc_nulls_last("total"), F.asc_nulls_last(dimension)]


def _narrowed(scope: Scope, period, grain) -> Scope:
    if period is None:
        if grain is not None:
            raise Refused("GRAIN_WITHOUT_PERIOD", "grain says what a period label means; name one")
        return scope
    return scope.period(period, grain or "month")


def _members(scope: Scope, dimension: str, measure: str) -> DataFrame:
    scope.contract.dimension(dimension)
    scope = scope.for_measure(measure, [dimension])
    return stage(group_totals(scope, [dimension], measure)
                 .withColumnRenamed(dimension, "member"))


def top_n(scope: Scope, dimension: str, measure: str, n: int = 10, period=None, grain=None
          ) -> DataFrame:
    """The n groups with the largest declared aggregate; share only where shares mean something."""
    totals = _members(_narrowed(scope, period, grain), dimension, measure)
    basis = share_basis(scope, measure, totals)
    best = totals.orderBy(*_order()).limit(n)
    # n rows: one small window numbers them
    return ranked(best, _order()).select("rank", "member", F.col("total").cast("double").alias("total"),
                                         "rows", _share(basis).alias("share"))


def group_compare(scope: Scope, dimension: str, measure: str) -> DataFrame:
    """Seven statistics, total and share per group, with an all-rows row from the same pass."""
    m = scope.contract.measure(measure)
    scope = scope.for_measure(measure, [dimension])
    scope.contract.dimension(dimension)
    if m.of_sums:
        return _ratio_compare(scope, dimension, m)
    df = scope.df.withColumn("__x", finite(scope.df, measure).cast("double"))
    x = "__x"
    aggs = [F.count("*").alias("rows"), F.count(x).alias("n"), F.min(x).alias("min"),
            F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("stddev")]
    if m.agg in ("sum", "mean", "min", "max"):
        fn = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[m.agg]
        aggs.append(fn(x).alias("total"))
    elif m.agg in ("count", "count_distinct"):
        aggs.append(declared(m).cast("double").alias("total"))
    cols = [F.col(dimension).alias("member"), F.col(x)]
    if m.agg in ("count", "count_distinct"):
        cols.append(F.col(measure))
    # every row counts once in its group and once in the row for all
    levels = F.array(F.struct(F.lit("group").alias("level"), F.col("member")),
                     F.struct(F.lit("all").alias("level"),
                              F.lit(None).cast(df.schema[dimension].dataType).alias("member")))
    both = df.select(*cols).select(F.inline(levels), *[c for c in ("__x", measure) if c == x or len(cols) > 2])
    out = grouped(both, ["level", "member"], aggs, {"median": (x, 0.5)})
    if m.agg == "median":
        out = out.withColumn("total", F.col("median"))
    if m.agg in (None, "none"):
        out = out.withColumn("total", F.lit(None).cast("double"))
    out = stage(out)
    basis = share_basis(scope, measure, out.where(F.col("level") == "group"))
    return out.select("level", "member", "rows", "n", "min", "max", "mean", "median", "stddev",
                      "total", _share(basis).alias("share"))


def _ratio_compare(scope: Scope, dimension: str, m) -> DataFrame:
    """A ratio has no value per row, so only its counts and totals are shown."""
    both = F.col(m.name)["n"].isNotNull() & F.col(m.name)["d"].isNotNull()
    narrow = scope.df.select(F.col(dimension).alias("member"), m.name)
    out = narrow.groupingSets([[F.col("member")], []], F.col("member")).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("rows"), F.count_if(both).alias("n"),
        declared(m).alias("total"))
    none = F.lit(None).cast("double")
    return out.select(F.when(F.col("gid") == 0, "group").otherwise("all").alias("level"), "member",
                      "rows", "n", *[none.alias(c) for c in ("min", "max", "mean", "median", "stddev")],
                      "total", none.alias("share"))


def cross_tab(scope: Scope, rows: str, columns: str, measure: str | None = None) -> DataFrame:
    """Cells and margins in long form; margins are aggregates of rows, never sums of cells."""
    for d in (rows, columns):
        scope.contract.dimension(d)
    value = F.count("*") if measure is None else declared(scope.contract.measure(measure))
    df = scope.df.select(F.col(rows).alias("row_member"), F.col(columns).alias("column_member"),
                         *([measure] if measure else []))
    out = df.cube("row_member", "column_member").agg(
        F.grouping("row_member").alias("gr"), F.grouping("column_member").alias("gc"),
        value.alias("value"), F.count("*").alias("rows"))
    kind = (F.when((F.col("gr") == 0) & (F.col("gc") == 0), "cell")
            .when(F.col("gr") == 0, "row_total").when(F.col("gc") == 0, "column_total")
            .otherwise("total"))
    return out.select(kind.alias("kind"), "row_member", "column_member", "value", "rows")


def distribution(scope: Scope, measure: str, bins: int = 10) -> DataFrame:
    """Equal-width bins with count, share and running share; whole-number bins for integers."""
    if not 2 <= bins <= 50:
        raise Refused("BAD_BINS", "bins must be 2 to 50")
    row_values_needed(scope.contract.measure(measure))
    df = scope.df
    integer = is_kind(df, measure, INTEGRAL)
    x = finite(df, measure)
    b = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    lo, hi, n = b["lo"], b["hi"], b["n"]
    if not n:
        raise Refused("NO_VALUES", f"{measure} has no finite value in scope")
    if integer:
        span = hi - lo + 1
        width = -(-span // bins)
        k = -(-span // width)
        idx = F.floor((x - F.lit(lo)) / F.lit(width))
        edges = [float(lo + i * width) for i in range(k)] + [float(hi)]
    else:
        k, lo, hi = bins, float(lo), float(hi)
        edges = [lo] + [lo + (hi - lo) * i / bins for i in range(1, bins)] + [hi]
        # the same edges decide membership, so a value on an edge lands where the edge says
        idx = F.lit(0)
        for i in range(1, bins):
            idx = idx + (x >= F.lit(edges[i])).cast("int")
    idx = F.least(idx.cast("int"), F.lit(k - 1))
    counts = df.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count("*").alias("rows"))
    frame = df.sparkSession.range(k).select(F.col("id").cast("int").alias("bin"))
    lows, highs = F.array(*[F.lit(e) for e in edges[:-1]]), F.array(*[F.lit(e) for e in edges[1:]])
    out = frame.join(counts, "bin", "left").select(
        "bin", F.element_at(lows, F.col("bin") + 1).alias("lo"),
        F.element_at(highs, F.col("bin") + 1).alias("hi"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
    # k <= 50 rows from here on
    out = running(stage(out), [F.col("bin")], {"upto": F.col("rows")})
    return out.select("bin", "lo", "hi", "rows", (F.col("rows") / F.lit(n)).alias("share"),
                      (F.col("upto") / F.lit(n)).alias("running_share"))


QUANTILES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


def quantile_table(scope: Scope, measure: str, by: list[str] = ()) -> DataFrame:
    """Seven exact quantiles, wide, per group if asked."""
    df = scope.df.withColumn("__x", finite(scope.df, measure).cast("double"))
    names = {f"q{int(p * 100):03d}": ("__x", p) for p in QUANTILES}
    return grouped(df, list(by), [F.count("__x").alias("n")], names)


def _running_shares(scope, dimension, measure, period, grain):
    totals = _members(_narrowed(scope, period, grain), dimension, measure)
    basis = share_basis(scope, measure, totals)
    if basis is None:
        raise Refused("NO_SHARE", f"{measure} by {dimension} has no total to be a share of")
    run = running(totals, _order(), {"rank": F.lit(1).cast("long"),
                                     "upto": F.coalesce(F.col("total"), F.lit(0))})
    return run.select("rank", "member", F.col("total").cast("double").alias("total"), "rows",
                      _share(basis).alias("share"), (F.col("upto") / F.lit(basis))
                      .alias("running_share"))


def pareto(scope: Scope, dimension: str, measure: str, threshold: float = 80.0, period=None,
           grain=None) -> DataFrame:
    """Groups in order of size with running share; marks the first rank at the threshold."""
    run = _running_shares(scope, dimension, measure, period, grain)
    reached = F.round(F.col("running_share") * 100, 9) >= F.lit(float(threshold))
    before = F.round((F.col("running_share") - F.coalesce("share", F.lit(0.0))) * 100, 9)
    return run.withColumn("reaches", reached & (before < F.lit(float(threshold))))


#: The ranks and percentages at which concentration is read.
CUT_RANKS = (1, 3, 5, 10, 20)
CUT_PERCENTS = (1, 5, 10)
PERCENTS_FROM = 100


def concentration(scope: Scope, dimension: str, measure: str, period=None, grain=None) -> DataFrame:
    """Running share at fixed cuts, with the Herfindahl index and effective number of groups."""
    run = stage(_running_shares(scope, dimension, measure, period, grain))
    h = run.agg(F.count("*").alias("k"), F.sum(F.col("share") * F.col("share")).alias("s2")).first()
    k, hhi = h["k"], float(h["s2"]) * 10_000
    cuts = [(f"top {c}", c) for c in CUT_RANKS if c < k]
    if k >= PERCENTS_FROM:
        cuts += [(f"top {p}%", max(1, k * p // 100)) for p in CUT_PERCENTS]
    cuts.append(("all", k))
    wanted = df_of_cuts(run.sparkSession, cuts)
    return wanted.join(run, "rank").select(
        "cut", F.col("rank").alias("groups"), "running_share", F.lit(hhi).alias("hhi"),
        F.lit(10_000 / hhi).alias("effective_groups"))


def df_of_cuts(spark, cuts) -> DataFrame:
    """A dozen (name, rank) pairs as rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("cut"), F.lit(r).cast("long").alias("rank"))
                      for n, r in cuts])
    return spark.range(1).select(F.inline(pairs))


def ranking_shift(scope: Scope, dimension: str, measure: str, before, after) -> DataFrame:
    """Rank of each group in two date ranges; groups of only one range are new or gone."""
    m = scope.contract.measure(measure)
    total_needed(m)
    scope.contract.dimension(dimension)
    c = scope.contract.require_date()
    sides = []
    for which, (start, end) in (("before", before), ("after", after)):
        part = Scope(scope.df.where(in_window(c, start, end)), scope.contract)
        t = stage(group_totals(part, [dimension], measure).withColumnRenamed(dimension, "member"))
        r = ranked(t, _order())
        sides.append(r.select(F.col("member").alias(f"m_{which}"), F.lit(True).alias(f"in_{which}"),
                              F.col("total").cast("double").alias(f"total_{which}"),
                              F.col("rank").alias(f"rank_{which}")))
    both = sides[0].join(sides[1], F.col("m_before").eqNullSafe(F.col("m_after")), "full")
    moved = F.col("rank_before") - F.col("rank_after")
    status = (F.when(F.col("in_before").isNull(), "new").when(F.col("in_after").isNull(), "gone")
              .otherwise("both"))
    return both.select(F.when(F.col("in_after").isNull(), F.col("m_before"))
                       .otherwise(F.col("m_after")).alias("member"),
                       "total_before", "rank_before", "total_after", "rank_after",
                       moved.alias("change"), status.alias("status"))


def as_text_members(df: DataFrame, column: str = "member") -> DataFrame:
    return df.withColumn(column, text_of(column))
