"""Tier 1 and 2 analyses (section 2.5)."""

from ..operators import describe as d
from .base import LINES_SQL, ORDERS_SQL, entry, lines, orders

book: dict = {}

STATS = ("count({c})::BIGINT AS n, (count(*) - count({c}))::BIGINT AS nulls, 0::BIGINT AS non_finite, "
         "{t} AS total, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, avg({c}) AS mean, "
         "median({c}) AS median, stddev_samp({c}) AS stddev")


def _stat(name, column, total):
    return (f"SELECT '{name}' AS measure, {STATS.format(c=column, t=f'({total})::DOUBLE')} "
            f"FROM {LINES_SQL}")


@entry(book, "summary_stats", " UNION ALL ".join([
    _stat("quantity", "l_quantity", "sum(l_quantity)"),
    _stat("price", "l_extendedprice", "sum(l_extendedprice)"),
    _stat("avg_price", "l_extendedprice", "avg(l_extendedprice)"),
    _stat("discount", "l_discount", "avg(l_discount)"),
    _stat("rows_counted", "l_orderkey", "count(l_orderkey)"),
    _stat("disc_units", "disc_units", "sum(disc_units)"),
    _stat("bulk", "CAST(l_quantity > 25 AS INT)", "avg(CAST(l_quantity > 25 AS INT))"),
    "SELECT 'discount_rate', count(disc_value + l_extendedprice), "
    "count(*) - count(disc_value + l_extendedprice), 0, sum(disc_value) / nullif(sum(l_extendedprice), 0), "
    f"NULL, NULL, NULL, NULL, NULL FROM {LINES_SQL}"]),
    "total min max mean median stddev", 4)
def _(t):
    return d.summary_stats(lines(t))


@entry(book, "frequency", """
WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1),
 top AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 10), l AS (SELECT min(n) AS m FROM top)
SELECT value, n AS "rows", n / (SELECT sum(n) FROM c) AS share,
 CASE WHEN n = (SELECT m FROM l) THEN (SELECT count(*) FROM c WHERE n = (SELECT m FROM l)) END
 AS tied_with_last FROM top""", "share", 6)
def _(t):
    from ..contract import Contract
    from ..operators.scope import Scope
    return d.frequency(Scope.of(t("part"), Contract("part", dimensions=("p_brand",))), "p_brand", 10)


@entry(book, "top_n", """
WITH g AS (SELECT l_partkey AS member, sum(l_quantity) AS total, count(*) AS n FROM lineitem GROUP BY 1)
SELECT row_number() OVER (ORDER BY total DESC NULLS LAST, member) AS rank, member, total, n AS "rows",
 total / (SELECT sum(total) FROM g) AS share FROM g ORDER BY total DESC NULLS LAST, member LIMIT 10""",
       "total share", 6)
def _(t):
    return d.top_n(lines(t), "l_partkey", "quantity", 10)


@entry(book, "top_n_period", f"""
WITH g AS (SELECT o_custkey AS member, avg(o_totalprice) AS total, count(*) AS n FROM {ORDERS_SQL}
 WHERE date_trunc('month', o_orderdate) = DATE '1997-11-01' GROUP BY 1)
SELECT row_number() OVER (ORDER BY total DESC NULLS LAST, member) AS rank, member, total, n AS "rows",
 CAST(NULL AS DOUBLE) AS share FROM g ORDER BY total DESC NULLS LAST, member LIMIT 5""", "total")
def _(t):
    return d.top_n(orders(t), "o_custkey", "avg_price", 5, period="1997-11", grain="month")


COMPARE_SQL = """
WITH s AS (SELECT 'group' AS level, l_returnflag AS member, count(*) AS n, min(l_extendedprice) AS lo,
 max(l_extendedprice) AS hi, avg(l_extendedprice) AS m, median(l_extendedprice) AS med,
 stddev_samp(l_extendedprice) AS sd, sum(l_extendedprice) AS tot FROM lineitem GROUP BY 2
 UNION ALL SELECT 'all', NULL, count(*), min(l_extendedprice), max(l_extendedprice),
 avg(l_extendedprice), median(l_extendedprice), stddev_samp(l_extendedprice), sum(l_extendedprice)
 FROM lineitem)
SELECT level, member, n AS "rows", n AS n, lo AS min, hi AS max, m AS mean, med AS median, sd AS stddev,
 tot AS total, tot / (SELECT sum(tot) FROM s WHERE level = 'group') AS share FROM s"""


@entry(book, "group_compare", COMPARE_SQL,
       "min max mean median stddev total share", 4)
def _(t):
    return d.group_compare(lines(t), "l_returnflag", "price")


@entry(book, "group_compare_many", COMPARE_SQL.replace("l_returnflag", "l_suppkey"), "min max mean median stddev total share", 4)
def _(t):
    return d.group_compare(lines(t), "l_suppkey", "price")


TAB_SQL = """
WITH g AS (SELECT l_returnflag AS r, l_linestatus AS c, grouping(l_returnflag) AS gr,
 grouping(l_linestatus) AS gc, count(*) AS n FROM lineitem
 GROUP BY CUBE (l_returnflag, l_linestatus))
SELECT CASE WHEN gr = 0 AND gc = 0 THEN 'cell' WHEN gr = 0 THEN 'row_total'
 WHEN gc = 0 THEN 'column_total' ELSE 'total' END AS kind, r AS row_member, c AS column_member,
 n AS value, n AS "rows" FROM g"""


@entry(book, "cross_tab", TAB_SQL)
def _(t):
    return d.cross_tab(lines(t), "l_returnflag", "l_linestatus")


@entry(book, "cross_tab_many", TAB_SQL.replace("l_returnflag", "l_suppkey"))
def _(t):
    return d.cross_tab(lines(t), "l_suppkey", "l_linestatus")


@entry(book, "cross_tab_measure", f"""
WITH g AS (SELECT o_orderpriority AS r, o_orderstatus AS c, grouping(o_orderpriority) AS gr,
 grouping(o_orderstatus) AS gc, avg(o_totalprice) AS v, count(*) AS n FROM {ORDERS_SQL}
 GROUP BY CUBE (o_orderpriority, o_orderstatus))
SELECT CASE WHEN gr = 0 AND gc = 0 THEN 'cell' WHEN gr = 0 THEN 'row_total'
 WHEN gc = 0 THEN 'column_total' ELSE 'total' END AS kind, r AS row_member, c AS column_member,
 v AS value, n AS "rows" FROM g""", "value")
def _(t):
    return d.cross_tab(orders(t), "o_orderpriority", "o_orderstatus", "avg_price")


DIST = """
WITH b AS (SELECT min({c}) AS lo, max({c}) AS hi, count({c}) AS n FROM {f}),
 e AS (SELECT i::INT AS bin, lo + (hi - lo) * i / 10.0 AS a, CASE WHEN i = 9 THEN hi
  ELSE lo + (hi - lo) * (i + 1) / 10.0 END AS z, n FROM b, range(10) r(i)),
 c AS (SELECT e.bin, e.a, e.z, e.n, (SELECT count(*) FROM {f} WHERE {c} >= a AND
  ({c} < z OR (bin = 9 AND {c} <= z))) AS k FROM e)
SELECT bin, a AS lo, z AS hi, k AS "rows", k / n AS share,
 sum(k) OVER (ORDER BY bin) / n AS running_share FROM c"""


@entry(book, "distribution", DIST.format(c="o_totalprice", f=ORDERS_SQL),
       "lo hi share running_share")
def _(t):
    return d.distribution(orders(t), "revenue", 10)


@entry(book, "distribution_integer", """
WITH b AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part),
 w AS (SELECT lo, hi, ceil((hi - lo + 1) / 8.0)::INT AS w FROM b),
 k AS (SELECT *, ceil((hi - lo + 1) / w::DOUBLE)::INT AS k FROM w),
 s AS (SELECT i::INT AS bin, lo + i * w AS a, CASE WHEN i = k - 1 THEN hi ELSE lo + (i + 1) * w END AS z,
  k FROM k, range(8) r(i) WHERE i < k),
 c AS (SELECT bin, a, z, (SELECT count(*) FROM part WHERE p_size >= a AND
  (p_size < z OR (bin = k - 1 AND p_size <= z))) AS n FROM s)
SELECT bin, a::DOUBLE AS lo, z::DOUBLE AS hi, n AS "rows", n / sum(n) OVER () AS share,
 sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS running_share FROM c""", "lo hi share running_share")
def _(t):
    from ..contract import Contract, Measure
    from ..operators.scope import Scope
    c = Contract("part", measures=(Measure("p_size", "none"),))
    return d.distribution(Scope.of(t("part"), c), "p_size", 8)


RUN = """
WITH g AS (SELECT {dim} AS member, sum({v}) AS total, count(*) AS n FROM {f} GROUP BY 1),
 r AS (SELECT *, row_number() OVER (ORDER BY total DESC, member) AS rank,
  total / (SELECT sum(total) FROM g) AS share,
  sum(total) OVER (ORDER BY total DESC, member ROWS UNBOUNDED PRECEDING) / (SELECT sum(total) FROM g)
  AS running_share FROM g)"""


@entry(book, "pareto", RUN.format(dim="o_custkey", v="o_totalprice", f=ORDERS_SQL) + """,
 f AS (SELECT min(rank) AS first FROM r WHERE round(running_share * 100, 9) >= 80)
SELECT rank, member, total, n AS "rows", share, running_share, rank = first AS reaches FROM r, f""",
       "total share running_share", 6)
def _(t):
    return d.pareto(orders(t), "o_custkey", "revenue", 80)


@entry(book, "concentration", RUN.format(dim="l_suppkey", v="l_extendedprice", f="lineitem") + """,
 h AS (SELECT count(*) AS k, sum(share * share) * 10000 AS hhi FROM r),
 c AS (SELECT 'top ' || i AS cut, i::BIGINT AS rank FROM (VALUES (1), (3), (5), (10), (20)) v(i), h
  WHERE i < k UNION ALL SELECT 'top ' || p || '%', greatest(1, k * p // 100) FROM
  (VALUES (1), (5), (10)) v(p), h WHERE k >= 100 UNION ALL SELECT 'all', k FROM h)
SELECT cut, rank AS groups, running_share, hhi, 10000 / hhi AS effective_groups
FROM c JOIN r USING (rank), h""", "running_share hhi effective_groups", 5)
def _(t):
    return d.concentration(lines(t), "l_suppkey", "price")


@entry(book, "ranking_shift", f"""
WITH b AS (SELECT o_orderpriority AS m, sum(o_totalprice) AS tot FROM {ORDERS_SQL} WHERE
 o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND o_orderpriority <> '1-URGENT' GROUP BY 1),
 a AS (SELECT o_orderpriority AS m, sum(o_totalprice) AS tot FROM {ORDERS_SQL} WHERE
 o_orderdate::DATE BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND o_orderpriority <> '5-LOW' GROUP BY 1),
 rb AS (SELECT *, row_number() OVER (ORDER BY tot DESC, m) AS r FROM b),
 ra AS (SELECT *, row_number() OVER (ORDER BY tot DESC, m) AS r FROM a)
SELECT coalesce(ra.m, rb.m) AS member, rb.tot AS total_before, rb.r AS rank_before,
 ra.tot AS total_after, ra.r AS rank_after, rb.r - ra.r AS change,
 CASE WHEN rb.m IS NULL THEN 'new' WHEN ra.m IS NULL THEN 'gone' ELSE 'both' END AS status
FROM rb FULL JOIN ra ON ra.m = rb.m""", "total_before total_after", 2)
def _(t):
    s = orders(t)
    # one priority leaves and one arrives between the two years
    from pyspark.sql import functions as F
    from ..operators.scope import Scope
    y, p = F.year("o_orderdate"), F.col("o_orderpriority")
    df = s.df.where(~((y == 1996) & (p == "1-URGENT")) & ~((y == 1998) & (p == "5-LOW")))
    return d.ranking_shift(Scope(df, s.contract), "o_orderpriority", "revenue",
                           ("1996-01-01", "1996-12-31"), ("1998-01-01", "1998-12-31"))
