"""Tier 6 analyses (section 2.8). p-values are checked in tests; SQL checks the statistics."""

from pyspark.sql import functions as F

from ..operators import infer as i
from .base import LINES_SQL, entry, lines

book: dict = {}

MOM = ("SELECT {d} AS member, count(l_extendedprice) AS n, avg(l_extendedprice) AS mean, "
       "var_samp(l_extendedprice) AS variance FROM lineitem GROUP BY 1")


@entry(book, "group_moments", f"""
SELECT l_returnflag AS member, count(disc_units) AS n, avg(disc_units) AS mean,
 var_samp(disc_units) AS variance, skewness(disc_units) AS skewness, kurtosis(disc_units) AS kurtosis
FROM {LINES_SQL} GROUP BY 1""", "mean variance skewness kurtosis", 7)
def _(t):
    return i.group_moments(lines(t), "l_returnflag", "disc_units")


@entry(book, "test_set_aside", """
SELECT count(*) AS "rows", count(*) FILTER (WHERE l_returnflag IS NULL) AS no_group,
 count(*) FILTER (WHERE l_extendedprice IS NULL) AS no_value, 0::BIGINT AS not_finite FROM lineitem""")
def _(t):
    return i.set_aside(lines(t), "l_returnflag", "price")


STAT = ["test", "statistic", "df1", "df2", "effect"]


@entry(book, "hypothesis_test_welch", f"""
WITH g AS ({MOM.format(d='l_linestatus')}), a AS (SELECT * FROM g ORDER BY member LIMIT 1),
 b AS (SELECT * FROM g ORDER BY member DESC LIMIT 1),
 s AS (SELECT a.n AS na, b.n AS nb, a.mean AS ma, b.mean AS mb, a.variance AS va, b.variance AS vb FROM a, b)
SELECT 'welch' AS test, (ma - mb) / sqrt(va / na + vb / nb) AS statistic,
 (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS df1,
 CAST(NULL AS DOUBLE) AS df2,
 (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) * (1 - 3.0 / (4.0 * (na + nb - 2) - 1))
 AS effect FROM s""", "statistic df1 effect", 6)
def _(t):
    return i.hypothesis_test(lines(t), "l_linestatus", "price").select(*STAT)


@entry(book, "hypothesis_test", f"""
WITH g AS ({MOM.format(d='l_returnflag')}),
 t AS (SELECT sum(n) AS n, sum(n * mean) / sum(n) AS m, count(*) AS k FROM g),
 s AS (SELECT sum(g.n * (mean - m) ** 2) AS b, sum((g.n - 1) * variance) AS w FROM g, t)
SELECT 'anova' AS test, (b / (k - 1)) / (w / (n - k)) AS statistic, (k - 1)::DOUBLE AS df1,
 (n - k)::DOUBLE AS df2, b / (b + w) AS effect FROM s, t""", "statistic df1 df2 effect", 7)
def _(t):
    return i.hypothesis_test(lines(t), "l_returnflag", "price").select(*STAT)


RANKED = ("SELECT {d} AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1)"
          " / 2.0 AS r FROM lineitem")


@entry(book, "hypothesis_test_mann_whitney", f"""
WITH k AS ({RANKED.format(d='l_linestatus')}), a AS (SELECT min(g) AS f FROM k)
SELECT 'mann_whitney' AS test, sum(r) - count(*) * (count(*) + 1) / 2.0 AS statistic FROM k, a
WHERE g = f""", "statistic", 2)
def _(t):
    return i.hypothesis_test(lines(t), "l_linestatus", "quantity", method="rank").select(
        "test", "statistic")


@entry(book, "hypothesis_test_kruskal", f"""
WITH k AS ({RANKED.format(d='l_returnflag')}),
 s AS (SELECT g, sum(r) AS rs, count(*) AS n FROM k GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS n FROM s),
 h AS (SELECT 12.0 / (any_value(t.n) * (any_value(t.n) + 1)) * sum(rs * rs / s.n) - 3.0 * (any_value(t.n) + 1) AS h
  FROM s, t),
 c AS (SELECT sum(x::DOUBLE * x * x - x) AS c FROM (SELECT count(*) AS x FROM lineitem GROUP BY l_quantity))
SELECT 'kruskal_wallis' AS test, h / (1 - c / (n ** 3 - n)) AS statistic, 2.0 AS df1 FROM h, c, t""",
       "statistic df1", 6)
def _(t):
    return i.hypothesis_test(lines(t), "l_returnflag", "quantity", method="rank").select(
        "test", "statistic", "df1")


CHI = """
WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {f} GROUP BY 1, 2),
 x AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM c)"""


@entry(book, "hypothesis_test_chi_square", CHI.format(
    a="l_returnflag", b="l_linestatus", f="lineitem") + """
SELECT 'chi_square' AS test, sum((o - e) ** 2 / e) AS statistic, 2.0 AS df1,
 sqrt(sum((o - e) ** 2 / e) / sum(o)) AS effect FROM x""", "statistic df1 effect", 8)
def _(t):
    return i.hypothesis_test(lines(t), "l_returnflag", second_dimension="l_linestatus").select(
        "test", "statistic", "df1", "effect")


@entry(book, "effect_size", f"""
WITH g AS ({MOM.format(d='l_returnflag')}),
 t AS (SELECT sum(n * mean) / sum(n) AS m FROM g),
 s AS (SELECT sum(g.n * (mean - m) ** 2) AS b, sum((g.n - 1) * variance) AS w FROM g, t)
SELECT 'eta_squared' AS kind, b / (b + w) AS value, 'negligible' AS band FROM s""", "value", 8)
def _(t):
    return i.effect_size(lines(t), "l_returnflag", "price")


@entry(book, "effect_size_g", f"""
WITH g AS ({MOM.format(d='l_linestatus')}), a AS (SELECT * FROM g ORDER BY member LIMIT 1),
 b AS (SELECT * FROM g ORDER BY member DESC LIMIT 1)
SELECT 'hedges_g' AS kind, (a.mean - b.mean) / sqrt(((a.n - 1) * a.variance + (b.n - 1) * b.variance)
 / (a.n + b.n - 2)) * (1 - 3.0 / (4.0 * (a.n + b.n - 2) - 1)) AS value, 'negligible' AS band FROM a, b""",
       "value", 7)
def _(t):
    return i.effect_size(lines(t), "l_linestatus", "price")


@entry(book, "effect_size_v", CHI.format(a="l_returnflag", b="l_linestatus", f="lineitem") + """
SELECT 'cramers_v' AS kind, sqrt(sum((o - e) ** 2 / e) / sum(o)) AS value, 'negligible' AS band FROM x""",
       "value", 8)
def _(t):
    return i.effect_size(lines(t), "l_returnflag", second_dimension="l_linestatus")


@entry(book, "confidence_interval", """
SELECT l_returnflag AS member, count(*) AS n, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1""",
       "mean")
def _(t):
    # the bounds need Student's t, which SQL does not have: tests check them
    return i.confidence_interval(lines(t), "l_returnflag", "price").where(
        F.col("low") < F.col("high")).select("member", "n", "mean")


@entry(book, "confidence_interval_share", """
WITH g AS (SELECT l_returnflag AS member, count(*) AS n FROM lineitem GROUP BY 1),
 p AS (SELECT member, n, sum(n) OVER ()::DOUBLE AS t, n / sum(n) OVER ()::DOUBLE AS p,
  1.959963984540054 AS z FROM g)
SELECT member, n, p AS share,
 ((p + z * z / (2 * t)) - z * sqrt(p * (1 - p) / t + z * z / (4 * t * t))) / (1 + z * z / t) AS low,
 ((p + z * z / (2 * t)) + z * sqrt(p * (1 - p) / t + z * z / (4 * t * t))) / (1 + z * z / t) AS high FROM p""",
       "share low high", 8)
def _(t):
    return i.confidence_interval(lines(t), "l_returnflag")


@entry(book, "sample_adequacy", f"""
WITH g AS ({MOM.format(d='l_linestatus')}), a AS (SELECT * FROM g ORDER BY member LIMIT 1),
 b AS (SELECT * FROM g ORDER BY member DESC LIMIT 1)
SELECT a.n AS n1, b.n AS n2, sqrt(((a.n - 1) * a.variance + (b.n - 1) * b.variance) / (a.n + b.n - 2))
 AS pooled_sd, a.mean - b.mean AS observed, 394::BIGINT AS rows_for_2, 64::BIGINT AS rows_for_5,
 26::BIGINT AS rows_for_8 FROM a, b""", "pooled_sd observed", 3)
def _(t):
    return i.sample_adequacy(lines(t), "l_linestatus", "price").select(
        "n1", "n2", "pooled_sd", "observed", "rows_for_2", "rows_for_5", "rows_for_8")
