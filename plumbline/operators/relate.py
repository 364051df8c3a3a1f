"""Tier 4 and 5: how measures move together, and where they stop behaving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.aggs import declared, finite, guarded_corr, row_values_needed, total_needed
from ..functions.quantiles import bucket_of, grouped, null_safe_join
from ..functions.staging import ranked, small_side, stage
from .periods import on_calendar, per_period
from .scope import Scope


def _pairs(scope: Scope, measure: str, against: str) -> DataFrame:
    if measure == against:
        raise Refused("SAME_MEASURE", "a measure cannot be set against itself")
    for name in (measure, against):
        row_values_needed(scope.contract.measure(name))
    df = scope.df.select(finite(scope.df, measure).cast("double").alias("x"),
                         finite(scope.df, against).cast("double").alias("y"))
    return df.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def correlation(scope: Scope, measure: str, against: str, small_rows: int | None = None
                ) -> DataFrame:
    """Pearson and Spearman over complete pairs; blank under 3 pairs or with a flat side.

    Ranks come from the two value histograms, so no row is ever sorted against all others.
    """
    pairs = _pairs(scope, measure, against)
    # equal pairs collapse before the rank joins, which is also what splits a hot value
    cells = stage(pairs.groupBy("x", "y").agg(F.count("*").alias("c")))
    hist_x = cells.select("x", F.col("c"))
    rx = _weighted_midranks(hist_x, "x", small_rows).select("x", F.col("midrank").alias("rx"))
    ry = _weighted_midranks(cells.select("y", "c"), "y", small_rows).select(
        "y", F.col("midrank").alias("ry"))
    n = F.col("c")
    base = cells.agg(F.sum("c").alias("pairs"), F.min("x").alias("x0"), F.max("x").alias("x1"),
                     F.min("y").alias("y0"), F.max("y").alias("y1"),
                     (F.sum(F.col("x") * n) / F.sum(n)).alias("mx"),
                     (F.sum(F.col("y") * n) / F.sum(n)).alias("my")).first()
    count = base["pairs"] or 0
    flat = count < 3 or base["x0"] == base["x1"] or base["y0"] == base["y1"]
    if flat:
        empty = F.lit(None).cast("double")
        return scope.df.agg(F.count("*").alias("__n")).select(
            F.lit(count).cast("long").alias("pairs"),
            (F.col("__n") - F.lit(count)).alias("dropped"), empty.alias("pearson"),
            empty.alias("spearman"), F.lit(False).alias("disagree"))
    mid = (count + 1) / 2.0
    joined = cells.join(rx, "x").join(ry, "y")
    dx, dy = F.col("x") - F.lit(base["mx"]), F.col("y") - F.lit(base["my"])
    ex, ey = F.col("rx") - F.lit(mid), F.col("ry") - F.lit(mid)
    r = joined.agg(
        (F.sum(n * dx * dy) / F.sqrt(F.sum(n * dx * dx) * F.sum(n * dy * dy))).alias("pearson"),
        (F.sum(n * ex * ey) / F.sqrt(F.sum(n * ex * ex) * F.sum(n * ey * ey))).alias("spearman"))
    rows = scope.df.agg(F.count("*"))
    return r.select(F.lit(count).cast("long").alias("pairs"),
                    (rows.scalar() - F.lit(count)).cast("long").alias("dropped"), "pearson",
                    "spearman", (F.abs(F.col("pearson") - F.col("spearman")) >= 0.1).alias("disagree"))


def _weighted_midranks(cells: DataFrame, value: str, small_rows: int | None) -> DataFrame:
    from ..functions.staging import running
    hist = stage(cells.groupBy(value).agg(F.sum("c").alias("ties")))
    extra = {} if small_rows is None else {"small_rows": small_rows}
    cum = running(hist, [F.col(value)], {"__upto": F.col("ties")}, **extra)
    return cum.select(value, (F.col("__upto") - (F.col("ties") - 1) / 2).alias("midrank"))


def pearson_by(scope: Scope, measure: str, against: str, dimension: str) -> DataFrame:
    """Pearson r per group, NULL where a side is flat."""
    return scope.df.groupBy(F.col(dimension).alias("member")).agg(
        guarded_corr(F.col(measure), F.col(against)).alias("pearson"))


def ntile_bounds(values: DataFrame, column: str, bins: int, small_rows: int | None = None
                 ) -> list[float]:
    """Upper edge of each near-equal block of the distinct values; at most ``bins`` numbers.

    The first ``K mod bins`` blocks hold one value more, as ntile does.
    """
    distinct = stage(values.select(column).distinct())
    extra = {} if small_rows is None else {"small_rows": small_rows}
    numbered = ranked(distinct, [F.col(column)], "rk", **extra)
    k = distinct.count()
    base, rem = divmod(k, bins)
    wide = rem * (base + 1)
    rk = F.col("rk")
    if base == 0:
        tile: Column = rk
    else:
        tile = F.when(rk <= wide, F.ceil(rk / F.lit(base + 1))).otherwise(
            F.lit(rem) + F.ceil((rk - F.lit(wide)) / F.lit(base)))
    tops = numbered.groupBy(tile.alias("tile")).agg(F.max(column).alias("top"))
    return sorted(r["top"] for r in tops.collect())      # at most ``bins`` rows


def bivariate(scope: Scope, measure: str, against: str, bins: int = 10) -> DataFrame:
    """How y behaves across the range of x, binned over distinct x so ties stay together."""
    if not 2 <= bins <= 50:
        raise Refused("BAD_BINS", "bins must be 2 to 50")
    pairs = _pairs(scope, measure, against)
    tops = ntile_bounds(pairs, "x", bins)
    binned = pairs.withColumn("bin", bucket_of("x", tops) + 1)
    return grouped(binned, ["bin"], [
        F.min("x").alias("x_from"), F.max("x").alias("x_to"), F.count("*").alias("rows"),
        F.avg("y").alias("mean_y")], {"median_y": ("y", 0.5)})


def rate_by_bins(scope: Scope, measure: str, against: str, bins: int = 10) -> DataFrame:
    """A ratio of sums across the range of another measure, binned over its distinct values."""
    m = scope.contract.measure(measure)
    if not m.of_sums:
        raise Refused("NOT_A_RATIO", f"{measure} is agg={m.agg}; bivariate reads row values")
    row_values_needed(scope.contract.measure(against))
    df = scope.df.withColumn("x", finite(scope.df, against).cast("double")).where(
        F.col("x").isNotNull())
    tops = ntile_bounds(df, "x", bins)
    return df.groupBy((bucket_of("x", tops) + 1).alias("bin")).agg(
        F.min("x").alias("x_from"), F.max("x").alias("x_to"), F.count("*").alias("rows"),
        declared(m).alias("rate"))


def driver_analysis(scope: Scope, measure: str) -> DataFrame:
    """Share of a measure's variance lying between the groups of each declared dimension.

    All dimensions are grouped in one scan; only (count, mean) per group leaves it.
    """
    dims = list(scope.contract.dimensions)
    if not dims:
        raise Refused("NO_DIMENSIONS", "the contract declares no dimension")
    row_values_needed(scope.contract.measure(measure))
    df = scope.df.select(*dims, finite(scope.df, measure).cast("double").alias("__y"))
    df = df.where(F.col("__y").isNotNull())
    t = df.agg(F.count("*").alias("n"), F.avg("__y").alias("m"), F.var_pop("__y").alias("v")).first()
    n, grand = t["n"], t["m"]
    sst = (t["v"] or 0.0) * n
    if n < 2 or not sst:
        raise Refused("NO_VARIANCE", f"{measure} does not vary in scope")
    sets = df.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims])
    # the set a row belongs to is the one dimension grouping() reports as present
    which = reduce(lambda acc, d: F.when(F.grouping(d) == 0, F.lit(d)).otherwise(acc),
                   reversed(dims), F.lit(None).cast("string"))
    groups = sets.agg(which.alias("dimension"), F.count("*").alias("n"), F.avg("__y").alias("m"))
    dm = F.col("m") - F.lit(grand)
    out = groups.groupBy("dimension").agg(
        F.count("*").alias("groups"), F.sum("n").alias("rows"),
        (F.sum(F.col("n") * dm * dm) / F.lit(sst)).alias("share"),
        F.count_if(F.col("n") == 1).alias("one_row_groups"))
    chance = (F.col("groups") - 1) / F.lit(n - 1)
    return out.select("dimension", "groups", "rows", "share", chance.alias("chance"),
                      (F.col("share") - chance).alias("excess"), "one_row_groups")


#: The fence and deviation multiples, and the fewest values a quartile needs.
IQR_FENCE, DEVIATIONS, MAD_TO_SIGMA, MIN_VALUES = 1.5, 3.0, 1.4826, 8


def _stats_and_mad(df: DataFrame, keys: list[str]):
    stats = stage(grouped(df, keys, [F.count("__x").alias("n"), F.avg("__x").alias("m"),
                                     F.stddev_samp("__x").alias("sd")],
                          {"q1": ("__x", .25), "med": ("__x", .5), "q3": ("__x", .75)}))
    if keys:
        near = null_safe_join(df, small_side(stats.select(*keys, "med")), keys, "left")
    else:
        near = df.withColumn("med", F.lit(stats.first()["med"]))
    dev = near.withColumn("__dev", F.abs(F.col("__x") - F.col("med")))
    mad = grouped(dev, keys, [], {"mad": ("__dev", .5)})
    if keys:
        return null_safe_join(stats, mad, keys, "left")
    return stats.withColumn("mad", F.lit(mad.first()["mad"]).cast("double"))


def _with_bounds(stats: DataFrame) -> DataFrame:
    iqr = F.col("q3") - F.col("q1")
    ok = F.col("n") >= MIN_VALUES
    half_z = F.lit(DEVIATIONS) * F.col("sd")
    half_m = F.lit(DEVIATIONS * MAD_TO_SIGMA) * F.col("mad")
    live_z, live_m = ok & (F.col("sd") > 0), ok & (F.col("mad") > 0)
    return stats.withColumns({
        "tukey_lo": F.when(ok, F.col("q1") - F.lit(IQR_FENCE) * iqr),
        "tukey_hi": F.when(ok, F.col("q3") + F.lit(IQR_FENCE) * iqr),
        "z_lo": F.when(live_z, F.col("m") - half_z), "z_hi": F.when(live_z, F.col("m") + half_z),
        "mad_lo": F.when(live_m, F.col("med") - half_m),
        "mad_hi": F.when(live_m, F.col("med") + half_m)})


def _outside(method: str) -> Column:
    x = F.col("__x")
    return F.coalesce((x < F.col(f"{method}_lo")) | (x > F.col(f"{method}_hi")), F.lit(False))


METHODS = ("tukey", "z", "mad")


def outlier_bounds(scope: Scope, measure: str, dimension: str | None = None) -> DataFrame:
    row_values_needed(scope.contract.measure(measure))
    if dimension:
        scope.contract.dimension(dimension)
    df = _valued(scope, measure, dimension)
    return _with_bounds(_stats_and_mad(df, ["member"] if dimension else []))


def _valued(scope: Scope, measure: str, dimension: str | None) -> DataFrame:
    keys = [F.col(dimension).alias("member")] if dimension else []
    df = scope.df.select(*keys, finite(scope.df, measure).cast("double").alias("__x"))
    return df.where(F.col("__x").isNotNull())


def _flagged(scope: Scope, measure: str) -> DataFrame:
    b = stage(outlier_bounds(scope, measure)).first()
    if b["n"] < MIN_VALUES:
        raise Refused("TOO_FEW_VALUES", f"{measure} has {b['n']} value(s); {MIN_VALUES} are needed")
    df = _valued(scope, measure, None)
    ends = {f"{m}_{e}": F.lit(b[f"{m}_{e}"]).cast("double") for m in METHODS for e in ("lo", "hi")}
    return df.withColumns(ends)


def outlier_detection(scope: Scope, measure: str) -> DataFrame:
    """Tukey, z-score and MAD at once: bounds, flagged rows, share. A dead method has no bounds."""
    df = _flagged(scope, measure)
    wide = df.agg(F.count("*").alias("n"), *[F.count_if(_outside(m)).alias(m) for m in METHODS],
                  *[F.first(f"{m}_{e}").alias(f"{m}_{e}") for m in METHODS for e in ("lo", "hi")])
    rows = [F.struct(F.lit(m).alias("method"), F.col(f"{m}_lo").alias("lower"),
                     F.col(f"{m}_hi").alias("upper"), F.col(m).alias("flagged"),
                     (F.col(m) / F.col("n")).alias("share")) for m in METHODS]
    out = wide.select(F.inline(F.array(*rows)))
    dead = F.col("lower").isNull()
    return out.select("method", "lower", "upper",
                      F.when(~dead, F.col("flagged")).alias("flagged"),
                      F.when(~dead, F.col("share")).alias("share"))


def outlier_agreement(scope: Scope, measure: str) -> DataFrame:
    """How many rows one, two or all three methods flag."""
    votes = reduce(lambda a, b: a + b, [_outside(m).cast("int") for m in METHODS])
    return (_flagged(scope, measure).groupBy(votes.alias("methods")).agg(F.count("*").alias("rows"))
            .where(F.col("methods") > 0))


def outlier_within(scope: Scope, measure: str, dimension: str) -> DataFrame:
    """The three methods inside each group; NULL is a group; small groups get no bounds."""
    bounds = stage(outlier_bounds(scope, measure, dimension))
    df = null_safe_join(_valued(scope, measure, dimension), small_side(bounds), ["member"])
    per = df.groupBy("member").agg(*[F.count_if(_outside(m)).alias(f"{m}_flagged")
                                     for m in METHODS])
    out = null_safe_join(bounds.select("member", "n", "tukey_lo", "tukey_hi"), per, ["member"])
    ok = F.col("n") >= MIN_VALUES
    return out.select("member", "n", "tukey_lo", "tukey_hi",
                      *[F.when(ok, F.col(f"{m}_flagged")).alias(f"{m}_flagged") for m in METHODS])


#: Periods needed on each side of a break, and the separation called a break.
MIN_SEGMENT, SEPARATION = 3, 2.0


def _splits(series: DataFrame, value: str = "value") -> DataFrame:
    """Every admissible split of a calendar series from prefix sums.

    ``series`` has one row per period of the calendar (period, value, rows), so these windows are
    as long as the calendar.
    """
    present = F.col("rows") > 0
    x = F.when(present, F.col(value)).cast("double")
    # centred on the series mean first, so that the sums of squares keep their digits
    mean = series.agg(F.avg(x)).first()[0]
    base = series.withColumn("__v", x - F.lit(float(mean) if mean is not None else 0.0))
    base = base.withColumn("__p", present.cast("long"))
    up = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.orderBy("period").rowsBetween(1, Window.unboundedFollowing)
    nxt = Window.orderBy("period")
    v = F.col("__v")
    base = base.withColumns({
        "n0": F.sum("__p").over(up), "n1": F.coalesce(F.sum("__p").over(down), F.lit(0)),
        "s0": F.sum(v).over(up), "s1": F.sum(v).over(down),
        "q0": F.sum(v * v).over(up), "q1": F.sum(v * v).over(down),
        "next_present": F.lead("__p").over(nxt), "next_period": F.lead("period").over(nxt),
        "index": F.row_number().over(nxt)})
    keep = ((F.col("n0") >= MIN_SEGMENT) & (F.col("n1") >= MIN_SEGMENT) & (F.col("__p") == 1)
            & (F.col("next_present") == 1))
    base = base.where(keep)
    mb, ma = F.col("s0") / F.col("n0"), F.col("s1") / F.col("n1")
    residual = (F.greatest(F.col("q0") - F.col("s0") * mb, F.lit(0.0))
                + F.greatest(F.col("q1") - F.col("s1") * ma, F.lit(0.0)))
    spread = F.sqrt(residual / F.nullif(F.col("n0") + F.col("n1") - 2, F.lit(0)))
    tiny = residual <= F.lit(1e-12) * (F.col("q0") + F.col("q1"))
    shift = F.lit(float(mean) if mean is not None else 0.0)
    return base.select("index", F.col("period").alias("split_after"), F.col("n0").alias("before"),
                       F.col("n1").alias("after"), (mb + shift).alias("mean_before"),
                       (ma + shift).alias("mean_after"), (ma - mb).alias("difference"),
                       F.when(~tiny, F.abs(ma - mb) / spread).alias("separation"))


def changepoint(scope: Scope, measure: str, grain: str = "month") -> DataFrame:
    """Every split with enough periods on both sides and no gap beside it, best first by size.

    ``separation`` is NULL when neither side varies at all.
    """
    total_needed(scope.contract.measure(measure))
    from .temporal import trend
    series = stage(trend(scope, measure, grain))
    return _splits(series).drop("index")


def _paired_series(scope: Scope, measure: str, against: str, grain: str) -> DataFrame:
    ma, mb = scope.contract.measure(measure), scope.contract.measure(against)
    for m in (ma, mb):
        total_needed(m)
    both = F.col(measure).isNotNull() & F.col(against).isNotNull()
    frame = per_period(scope, [declared(ma, both).cast("double").alias("a"),
                               declared(mb, both).cast("double").alias("b"),
                               F.count_if(both).alias("rows")], grain)
    return stage(on_calendar(scope, frame, grain))


def correlated_shift(scope: Scope, measure: str, against: str, grain: str = "month",
                     tolerance: int = 1) -> DataFrame:
    """Best break of each of two series on shared rows, and how likely they coincide by chance."""
    series = _paired_series(scope, measure, against, grain)
    bests = []
    for name, col in ((measure, "a"), (against, "b")):
        s = _splits(series, col)
        best = s.orderBy(F.desc(F.abs("difference")), "split_after").limit(1)
        candidates = s.agg(F.count("*"))
        bests.append(best.select(F.lit(name).alias("series"), "split_after", "difference",
                                 "separation", "index", candidates.scalar().alias("candidates")))
    both = bests[0].unionByName(bests[1])
    apart = both.agg((F.max("index") - F.min("index")).alias("apart"))
    chance = F.least(F.lit(1.0), F.lit(2.0 * tolerance + 1) / F.col("candidates"))
    return both.select("series", "split_after", "difference", "separation", "candidates",
                       apart.scalar().cast("int").alias("periods_apart"),
                       (apart.scalar() <= F.lit(tolerance)).alias("same_break"),
                       chance.alias("chance"))
