"""Tier 6: tests and intervals from sufficient statistics.

Spark reduces the rows to moments, rank sums or a contingency table; the last step is arithmetic on
at most a few dozen numbers.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..functions import dist
from ..functions.aggs import finite, non_finite_count, sample_kurtosis, sample_skewness
from ..functions.ranks import rank_sums, tie_term
from ..functions.staging import stage
from .scope import Scope


def group_moments(scope: Scope, dimension: str, measure: str) -> DataFrame:
    """n, mean, sample variance, skewness and excess kurtosis per named group of finite values."""
    scope.contract.dimension(dimension)
    scope.contract.measure(measure)
    df = scope.df.select(F.col(dimension).alias("member"),
                         finite(scope.df, measure).cast("double").alias("x"))
    df = df.where(F.col("member").isNotNull() & F.col("x").isNotNull())
    n = F.count("x")
    return df.groupBy("member").agg(n.alias("n"), F.avg("x").alias("mean"),
                                    F.var_samp("x").alias("variance"),
                                    sample_skewness("x", n).alias("skewness"),
                                    sample_kurtosis("x", n).alias("kurtosis"))


def set_aside(scope: Scope, dimension: str, measure: str) -> DataFrame:
    """Rows a test does not read: no group, no value, value not finite."""
    named = F.col(dimension).isNotNull()
    bad = scope.df.where(named)
    return scope.df.agg(F.count("*").alias("rows"), F.count_if(~named).alias("no_group"),
                        F.count_if(named & F.col(measure).isNull()).alias("no_value")).withColumn(
        "not_finite", bad.agg(non_finite_count(bad, measure)).scalar())


class Groups:
    """What the tests need of all groups: their number and sums of squares; the groups themselves only if they are two."""

    def __init__(self, scope: Scope, dimension: str, measure: str):
        g = stage(group_moments(scope, dimension, measure))
        t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"),
                  F.count_if(F.col("n") < 2).alias("single"), F.count_if(F.col("variance").isNull()).alias("flat"),
                  F.sum((F.col("n") - 1) * F.coalesce("variance", F.lit(0.0))).alias("within")).first()
        self.k, self.n, self.single, self.flat = t["k"], t["n"] or 0, t["single"], t["flat"]
        self.within = t["within"] or 0.0
        off = F.col("mean") - F.lit((t["s"] or 0.0) / max(self.n, 1))
        self.between = g.agg(F.sum(F.col("n") * off * off)).first()[0] or 0.0
        self.pair = sorted(g.collect(), key=lambda r: str(r["member"])) if self.k == 2 else None


def welch(a, b):
    sa, sb = a["variance"] / a["n"], b["variance"] / b["n"]
    if sa + sb == 0:
        raise Refused("NO_VARIANCE", "both groups are constant")
    t = (a["mean"] - b["mean"]) / math.sqrt(sa + sb)
    df = (sa + sb) ** 2 / (sa ** 2 / (a["n"] - 1) + sb ** 2 / (b["n"] - 1))
    return t, df, 2.0 * dist.t_sf(abs(t), df)


def anova(groups: Groups):
    d1, d2 = groups.k - 1, groups.n - groups.k
    if groups.within == 0:
        raise Refused("NO_VARIANCE", "no group varies")
    f = (groups.between / d1) / (groups.within / d2)
    return f, d1, d2, dist.f_sf(f, d1, d2)


def hedges_g(a, b):
    dof = a["n"] + b["n"] - 2
    pooled = math.sqrt(((a["n"] - 1) * a["variance"] + (b["n"] - 1) * b["variance"]) / dof)
    if pooled == 0:
        raise Refused("NO_VARIANCE", "both groups are constant")
    return (a["mean"] - b["mean"]) / pooled * (1 - 3 / (4 * dof - 1))


def eta_squared(groups: Groups):
    whole = groups.between + groups.within
    return groups.between / whole if whole else 0.0


def chi_square(cells: DataFrame) -> dict:
    """Statistic, df, p, smallest expected count and plain (uncorrected) chi-square of ``a, b, n`` (cells with rows)."""
    cells = stage(cells)
    rows, cols = (stage(cells.groupBy(d).agg(F.sum("n").alias(f"t{d}"))) for d in ("a", "b"))
    r = rows.agg(F.count("*").alias("k"), F.sum("ta").alias("n"), F.min("ta").alias("low")).first()
    c = cols.agg(F.count("*").alias("k"), F.min("tb").alias("low")).first()
    if r["k"] < 2 or c["k"] < 2:
        raise Refused("TABLE_TOO_SMALL", "independence needs two values of each dimension")
    total = r["n"]
    expected = F.col("ta") * F.col("tb") / F.lit(float(total))
    # an empty cell adds what is expected in it, and all expectations add up to the total
    plain = cells.join(rows, "a").join(cols, "b").agg(F.sum(F.col("n") * F.col("n") / expected)).first()[0] - total
    stat = plain
    if r["k"] == 2 and c["k"] == 2:
        held = {(x["a"], x["b"]): x["n"] for x in cells.collect()}
        ra, cb = ({x[d]: x[f"t{d}"] for x in f.collect()} for f, d in ((rows, "a"), (cols, "b")))
        stat = 0.0
        for i, ti in ra.items():
            for j, tj in cb.items():
                e = ti * tj / total
                gap = abs(held.get((i, j), 0) - e)
                # the correction never moves a cell past its expectation
                stat += (gap - min(0.5, gap)) ** 2 / e
    df = (r["k"] - 1) * (c["k"] - 1)
    v = math.sqrt(max(plain, 0.0) / total / (min(r["k"], c["k"]) - 1))
    return {"statistic": stat, "df": df, "p": dist.chi2_sf(stat, df), "smallest": r["low"] * c["low"] / total,
            "plain": plain, "cramers_v": v, "n": total}


def _contingency(scope: Scope, a: str, b: str) -> DataFrame:
    if a == b:
        raise Refused("SAME_DIMENSION", "a dimension cannot be tested against itself")
    for d in (a, b):
        scope.contract.dimension(d)
    df = scope.df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def _result(scope: Scope, **values) -> DataFrame:
    """A one-row frame of driver numbers."""
    types = {str: "string", int: "long", float: "double", bool: "boolean"}
    cols = []
    for k, v in values.items():
        kind = "double" if v is None else types[type(v)]
        cols.append(F.lit(v).cast(kind).alias(k))
    return scope.df.sparkSession.range(1).select(*cols)


def mann_whitney(scope: Scope, dimension: str, measure: str) -> DataFrame:
    df = _ranked_values(scope, dimension, measure)
    sums = sorted(rank_sums(df, "x", "member").limit(3).collect(), key=lambda r: str(r["member"]))
    if len(sums) != 2:
        raise Refused("NOT_TWO_GROUPS", f"{dimension} has {'more' if len(sums) > 2 else len(sums)} groups")
    ties, n = tie_term(df, "x")
    n1, n2 = sums[0]["n"], sums[1]["n"]
    u = float(sums[0]["rank_sum"]) - n1 * (n1 + 1) / 2.0
    variance = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    if variance <= 0:
        raise Refused("ALL_TIED", "every value is tied")
    z = (abs(u - n1 * n2 / 2.0) - 0.5) / math.sqrt(variance)
    return _result(scope, test="mann_whitney", statistic=u, df1=None, df2=None,
                   p=2.0 * dist.norm_sf(z), effect=None)


def kruskal_wallis(scope: Scope, dimension: str, measure: str) -> DataFrame:
    df = _ranked_values(scope, dimension, measure)
    r2 = F.col("rank_sum").cast("double")
    k, spread = rank_sums(df, "x", "member").agg(F.count("*"), F.sum(r2 * r2 / F.col("n"))).first()
    ties, n = tie_term(df, "x")
    if k < 2 or n < 2:
        raise Refused("NOT_ENOUGH_GROUPS", "a rank test needs two groups and two values")
    h = 12.0 / (n * (n + 1)) * spread - 3.0 * (n + 1)
    correction = 1.0 - ties / (float(n) ** 3 - n)
    if correction <= 0:
        raise Refused("ALL_TIED", "every value is tied")
    h /= correction
    effect = eta_squared(Groups(scope, dimension, measure))
    return _result(scope, test="kruskal_wallis", statistic=h, df1=float(k - 1), df2=None,
                   p=dist.chi2_sf(h, k - 1), effect=effect)


def _ranked_values(scope: Scope, dimension: str, measure: str) -> DataFrame:
    scope.contract.dimension(dimension)
    return scope.df.select(F.col(dimension).alias("member"),
                           finite(scope.df, measure).cast("double").alias("x")).where(
        F.col("member").isNotNull() & F.col("x").isNotNull())


def hypothesis_test(scope: Scope, dimension: str, measure: str | None = None,
                    second_dimension: str | None = None, method: str = "auto") -> DataFrame:
    """One row: the test that applies, its statistic, degrees of freedom, p and effect size."""
    if (measure is None) == (second_dimension is None):
        raise Refused("ONE_OF_TWO", "pass exactly one of measure and second_dimension")
    if method not in ("auto", "parametric", "rank"):
        raise Refused("BAD_METHOD", method)
    if second_dimension is not None:
        if method == "rank":
            raise Refused("BAD_METHOD", "two dimensions are compared by chi-square")
        c = chi_square(_contingency(scope, dimension, second_dimension))
        return _result(scope, test="chi_square", statistic=c["statistic"], df1=float(c["df"]),
                       df2=None, p=c["p"], effect=c["cramers_v"])
    groups = Groups(scope, dimension, measure)
    if groups.k < 2:
        raise Refused("NOT_ENOUGH_GROUPS", f"{dimension} has {groups.k} group(s)")
    single = bool(groups.single)
    if method == "rank" or (method == "auto" and single):
        fn = mann_whitney if groups.k == 2 else kruskal_wallis
        return fn(scope, dimension, measure)
    if single:
        raise Refused("NO_VARIANCE", "a group holds one row, so it has no variance")
    if groups.k == 2:
        t, df, p = welch(*groups.pair)
        return _result(scope, test="welch", statistic=t, df1=df, df2=None, p=p,
                       effect=hedges_g(*groups.pair))
    f, d1, d2, p = anova(groups)
    return _result(scope, test="anova", statistic=f, df1=float(d1), df2=float(d2), p=p,
                   effect=eta_squared(groups))


#: Where an effect starts to be called small, medium and large.
BANDS = {"hedges_g": (0.2, 0.5, 0.8), "eta_squared": (0.01, 0.06, 0.14),
         "cramers_v": (0.1, 0.3, 0.5)}


def band(kind: str, value: float) -> str:
    small, medium, large = BANDS[kind]
    size = abs(value)
    return ("large" if size >= large else "medium" if size >= medium
            else "small" if size >= small else "negligible")


def effect_size(scope: Scope, dimension: str, measure: str | None = None,
                second_dimension: str | None = None) -> DataFrame:
    if (measure is None) == (second_dimension is None):
        raise Refused("ONE_OF_TWO", "pass exactly one of measure and second_dimension")
    if second_dimension is not None:
        kind, value = "cramers_v", chi_square(_contingency(scope, dimension, second_dimension))[
            "cramers_v"]
    else:
        groups = Groups(scope, dimension, measure)
        if groups.k < 2:
            raise Refused("NOT_ENOUGH_GROUPS", f"{dimension} has {groups.k} group(s)")
        if groups.k == 2:
            if groups.flat:
                raise Refused("NO_VARIANCE", "a group holds one row")
            kind, value = "hedges_g", hedges_g(*groups.pair)
        else:
            kind, value = "eta_squared", eta_squared(groups)
    return _result(scope, kind=kind, value=float(value), band=band(kind, value))


@F.pandas_udf(T.DoubleType())
def _t_quantile(dof: pd.Series, tail: pd.Series) -> pd.Series:
    """Student t with the given upper tail, once per distinct number of degrees of freedom."""
    q = float(tail.iloc[0]) if len(tail) else 0.025
    known = {d: dist.t_isf(q, d) for d in dof.dropna().unique() if d > 0}
    return dof.map(known)


def confidence_interval(scope: Scope, dimension: str | None = None, measure: str | None = None,
                        confidence: float = 0.95) -> DataFrame:
    """Student-t interval of each group's mean, or the Wilson interval of each group's share."""
    if not 0 < confidence < 1:
        raise Refused("BAD_CONFIDENCE", str(confidence))
    if measure is not None:
        df = scope.df.select((F.col(dimension) if dimension else F.lit("(all)")).alias("member"),
                             finite(scope.df, measure).cast("double").alias("x"))
        g = (df.where(F.col("member").isNotNull() & F.col("x").isNotNull()).groupBy("member")
             .agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")))
        t = _t_quantile((F.col("n") - 1).cast("double"), F.lit((1 - confidence) / 2))
        half = F.when(F.col("n") >= 2, t * F.col("sd") / F.sqrt("n"))
        return g.withColumn("half", half).select(
            "member", "n", "mean", (F.col("mean") - F.col("half")).alias("low"),
            (F.col("mean") + F.col("half")).alias("high"))
    if dimension is None:
        raise Refused("NOTHING_TO_BOUND", "pass a dimension, a measure or both")
    scope.contract.dimension(dimension)
    counts = scope.df.groupBy(F.col(dimension).alias("member")).agg(F.count("*").alias("n"))
    total = scope.df.agg(F.count("*"))
    z = dist.norm_ppf(1 - (1 - confidence) / 2)
    named = counts.where(F.col("member").isNotNull()).withColumn("total", total.scalar())
    p, n = F.col("n") / F.col("total"), F.col("total").cast("double")
    denom = F.lit(1.0) + F.lit(z * z) / n
    centre = (p + F.lit(z * z / 2) / n) / denom
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z * z / 4) / (n * n)) / denom
    return named.select("member", "n", p.alias("share"), (centre - half).alias("low"),
                        (centre + half).alias("high"))


def sample_adequacy(scope: Scope, dimension: str, measure: str, power: float = 0.8,
                    alpha: float = 0.05) -> DataFrame:
    """What two groups of this size could have detected, beside what was observed."""
    groups = Groups(scope, dimension, measure)
    if groups.k != 2 or groups.single:
        raise Refused("NOT_TWO_GROUPS", "two groups of two rows or more are needed")
    a, b = groups.pair
    dof = a["n"] + b["n"] - 2
    pooled = math.sqrt(((a["n"] - 1) * a["variance"] + (b["n"] - 1) * b["variance"]) / dof)
    d = dist.detectable_effect(a["n"], b["n"], alpha, power)
    need = {f"rows_for_{int(k * 10)}": math.ceil(dist.rows_for_effect(k, alpha, power) - 1e-6)
            for k in (0.2, 0.5, 0.8)}
    return _result(scope, n1=int(a["n"]), n2=int(b["n"]), pooled_sd=pooled, detectable_d=d,
                   detectable_units=d * pooled, observed=float(a["mean"] - b["mean"]), **need)
