"""Tier 4 and 5 analyses (section 2.7)."""

from ..operators import relate as r
from .base import LINES_SQL, entry, lines
from .temporal import GAPPY_SQL, MONTHLY, SPINE, gappy

book: dict = {}


@entry(book, "correlation", """
WITH p AS (SELECT l_extendedprice AS x, l_quantity AS y FROM lineitem),
 k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)
SELECT count(*) AS pairs, 0::BIGINT AS dropped, corr(x, y) AS pearson, corr(rx, ry) AS spearman,
 abs(corr(x, y) - corr(rx, ry)) >= 0.1 AS disagree FROM k""", "pearson spearman", 8)
def _(t):
    return r.correlation(lines(t), "price", "quantity")


@entry(book, "bivariate", """
WITH v AS (SELECT DISTINCT l_extendedprice AS x FROM lineitem),
 b AS (SELECT x, ntile(10) OVER (ORDER BY x) AS bin FROM v)
SELECT CAST(bin AS INT) AS bin, min(x) AS x_from, max(x) AS x_to, count(*) AS "rows",
 avg(l_quantity) AS mean_y, median(l_quantity) AS median_y FROM lineitem JOIN b ON l_extendedprice = x
GROUP BY 1""", "x_from x_to mean_y median_y")
def _(t):
    return r.bivariate(lines(t), "price", "quantity", 10)


DRIVERS = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, count(*) AS groups, CAST(sum(n) AS BIGINT) AS k, "
    f"sum(n * (m - (SELECT avg(y) FROM s)) ** 2) / (SELECT var_pop(y) * count(y) FROM s) AS share, "
    f"count(*) FILTER (WHERE n = 1) AS one_row_groups FROM (SELECT {d} AS g, count(*) AS n, "
    f"avg(l_extendedprice) AS m FROM lineitem GROUP BY 1)"
    for d in ("l_returnflag", "l_linestatus", "l_suppkey", "l_partkey", "l_linenumber", "l_orderkey"))


@entry(book, "driver_analysis", f"""
WITH s AS (SELECT l_extendedprice AS y FROM lineitem), d AS ({DRIVERS})
SELECT dimension, groups, k AS "rows", share, (groups - 1) / (k - 1) AS chance,
 share - (groups - 1) / (k - 1) AS excess, one_row_groups FROM d""", "share chance excess", 8)
def _(t):
    return r.driver_analysis(lines(t), "avg_price")


OUT = f"""
WITH d AS (SELECT disc_units AS x FROM {LINES_SQL}),
 s AS (SELECT count(x) AS n, avg(x) AS m, stddev_samp(x) AS sd, median(x) AS med,
  quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM d),
 a AS (SELECT median(abs(x - (SELECT med FROM s))) AS mad FROM d),
 b AS (SELECT n, q1 - 1.5 * (q3 - q1) AS tl, q3 + 1.5 * (q3 - q1) AS th, m - 3 * sd AS zl, m + 3 * sd AS zh,
  med - 3 * 1.4826 * mad AS al, med + 3 * 1.4826 * mad AS ah FROM s, a),
 f AS (SELECT CAST(x < tl OR x > th AS INT) AS t, CAST(x < zl OR x > zh AS INT) AS z,
  CAST(x < al OR x > ah AS INT) AS a FROM d, b)"""


@entry(book, "outlier_detection", OUT + """
SELECT 'tukey' AS method, tl AS lower, th AS upper, (SELECT sum(t) FROM f)::BIGINT AS flagged,
 (SELECT sum(t) FROM f) / n AS share FROM b UNION ALL
SELECT 'z', zl, zh, (SELECT sum(z) FROM f)::BIGINT, (SELECT sum(z) FROM f) / n FROM b UNION ALL
SELECT 'mad', al, ah, (SELECT sum(a) FROM f)::BIGINT, (SELECT sum(a) FROM f) / n FROM b""",
       "lower upper share", 6)
def _(t):
    return r.outlier_detection(lines(t), "disc_units")


@entry(book, "outlier_agreement", OUT + """
SELECT t + z + a AS methods, count(*) AS "rows" FROM f WHERE t + z + a > 0 GROUP BY 1""")
def _(t):
    return r.outlier_agreement(lines(t), "disc_units")


@entry(book, "outlier_within", f"""
WITH d AS (SELECT l_returnflag AS g, disc_units AS x FROM {LINES_SQL}),
 s AS (SELECT g, count(x) AS n, avg(x) AS m, stddev_samp(x) AS sd, median(x) AS med,
  quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM d GROUP BY 1),
 a AS (SELECT d.g, median(abs(x - med)) AS mad FROM d JOIN s ON d.g IS NOT DISTINCT FROM s.g GROUP BY 1)
SELECT d.g AS member, any_value(n) AS n, any_value(q1 - 1.5 * (q3 - q1)) AS tukey_lo,
 any_value(q3 + 1.5 * (q3 - q1)) AS tukey_hi,
 count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS tukey_flagged,
 count(*) FILTER (WHERE abs(x - m) > 3 * sd) AS z_flagged,
 count(*) FILTER (WHERE mad > 0 AND abs(x - med) > 3 * 1.4826 * mad) AS mad_flagged
FROM d JOIN s ON d.g IS NOT DISTINCT FROM s.g JOIN a ON a.g IS NOT DISTINCT FROM d.g GROUP BY 1""",
       "tukey_lo tukey_hi", 6)
def _(t):
    return r.outlier_within(lines(t), "disc_units", "l_returnflag")


def splits(series: str, tag: str) -> str:
    """Every admissible split by direct recomputation of both halves."""
    return f"""{tag}s AS (SELECT *, row_number() OVER (ORDER BY period) AS i FROM ({series})),
 {tag}p AS (SELECT c.i, c.period,
  (SELECT count(*) FROM {tag}s WHERE n > 0 AND i <= c.i) AS n0,
  (SELECT count(*) FROM {tag}s WHERE n > 0 AND i > c.i) AS n1,
  (SELECT avg(value) FROM {tag}s WHERE n > 0 AND i <= c.i) AS m0,
  (SELECT avg(value) FROM {tag}s WHERE n > 0 AND i > c.i) AS m1,
  (SELECT var_pop(value) * count(value) FROM {tag}s WHERE n > 0 AND i <= c.i) AS r0,
  (SELECT var_pop(value) * count(value) FROM {tag}s WHERE n > 0 AND i > c.i) AS r1
  FROM {tag}s c JOIN {tag}s nx ON nx.i = c.i + 1 WHERE c.n > 0 AND nx.n > 0),
 {tag}c AS (SELECT *, abs(m1 - m0) / sqrt((r0 + r1) / (n0 + n1 - 2)) AS sep FROM {tag}p
  WHERE n0 >= 3 AND n1 >= 3)"""


@entry(book, "changepoint", f"""
WITH {splits(MONTHLY, 'a_')}
SELECT period AS split_after, n0 AS before, n1 AS after, m0 AS mean_before, m1 AS mean_after,
 m1 - m0 AS difference, sep AS separation FROM a_c""",
       "mean_before mean_after difference separation", 5)
def _(t):
    return r.changepoint(gappy(t), "revenue", "month")


def _series(agg):
    return (f"SELECT s.period, d.v AS value, coalesce(d.n, 0) AS n FROM {SPINE} s LEFT JOIN (SELECT "
            f"date_trunc('month', o_orderdate)::DATE AS m, {agg} AS v, count(*) AS n FROM {GAPPY_SQL} "
            f"GROUP BY 1) d ON d.m = s.period")


@entry(book, "correlated_shift", f"""
WITH {splits(_series('sum(o_totalprice)'), 'a_')}, {splits(_series('avg(o_totalprice)'), 'b_')},
 x AS (SELECT *, (SELECT count(*) FROM a_c) AS k FROM a_c ORDER BY abs(m1 - m0) DESC, period LIMIT 1),
 y AS (SELECT *, (SELECT count(*) FROM b_c) AS k FROM b_c ORDER BY abs(m1 - m0) DESC, period LIMIT 1),
 u AS (SELECT 'revenue' AS series, * FROM x UNION ALL SELECT 'avg_price', * FROM y)
SELECT series, period AS split_after, m1 - m0 AS difference, sep AS separation, k AS candidates,
 CAST(abs((SELECT i FROM x) - (SELECT i FROM y)) AS INT) AS periods_apart,
 abs((SELECT i FROM x) - (SELECT i FROM y)) <= 1 AS same_break, least(1.0, 3.0 / k) AS chance FROM u""",
       "difference separation chance", 5)
def _(t):
    return r.correlated_shift(gappy(t), "revenue", "avg_price", "month")
