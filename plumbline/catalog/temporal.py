"""Tier 3 analyses (section 2.6)."""

from pyspark.sql import functions as F

from ..operators import periods, temporal as tm
from ..operators.scope import Scope
from .base import ORDERS_SQL, entry, orders

book: dict = {}

SPINE = ("(SELECT g::DATE AS period FROM generate_series(TIMESTAMP '1996-01-01', "
         "TIMESTAMP '1999-12-01', INTERVAL 1 MONTH) s(g))")

# no orders in these quarters: gaps the calendar has to show
GAPPY_SQL = (f"(SELECT * FROM {ORDERS_SQL} WHERE NOT (year(o_orderdate) = 1997 AND "
             "month(o_orderdate) IN (2, 3, 4)) AND NOT (year(o_orderdate) = 1998 AND month(o_orderdate) = 9))")


def gappy(t) -> Scope:
    s = orders(t)
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    return Scope(s.df.where(~((y == 1997) & m.isin(2, 3, 4)) & ~((y == 1998) & (m == 9))), s.contract)


@entry(book, "per_edges", f"""
SELECT DATE '1996-01-01' AS lo, DATE '1999-12-31' AS hi, min(o_orderdate)::DATE AS seen_lo,
 max(o_orderdate)::DATE AS seen_hi, count(*) FILTER (WHERE o_orderdate IS NULL) AS undated,
 min(o_orderdate)::DATE > DATE '1996-01-01' AS starts_late,
 max(o_orderdate)::DATE < DATE '1999-12-31' AS ends_early, false AS opens_mid_period
FROM {ORDERS_SQL}""")
def _(t):
    return periods.edges(orders(t), "month")


CAL = (f"SELECT s.period, coalesce(d.n, 0) AS n FROM {SPINE} s LEFT JOIN (SELECT "
       f"date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n FROM {GAPPY_SQL} GROUP BY 1) d "
       f"ON d.m = s.period")


@entry(book, "per_longest_gap", f"""
WITH c AS (SELECT *, row_number() OVER (ORDER BY period) AS pos FROM ({CAL})),
 g AS (SELECT pos - row_number() OVER (ORDER BY pos) AS grp FROM c WHERE n = 0),
 l AS (SELECT max(k) AS k FROM (SELECT count(*) AS k FROM g GROUP BY grp))
SELECT count(*) AS periods, count(*) FILTER (WHERE n > 0) AS present,
 count(*) FILTER (WHERE n = 0) AS missing, (SELECT coalesce(k, 0) FROM l) AS longest_gap FROM c""")
def _(t):
    return periods.longest_gap(gappy(t), "month")


@entry(book, "per_empty_months", f"""
SELECT period AS month FROM ({CAL}) WHERE n = 0 AND year(period) = 1997""")
def _(t):
    return periods.empty_months(gappy(t), "1997", "year")


@entry(book, "calendar_coverage", f"""
SELECT period, n AS "rows", n > 0 AS present FROM ({CAL})""")
def _(t):
    return tm.calendar_coverage(gappy(t), "month")


VALUED = ("SELECT s.period, d.v AS value, coalesce(d.n, 0) AS n FROM {spine} s LEFT JOIN (SELECT "
          "{trunc}::DATE AS m, {agg} AS v, count(*) AS n FROM {f} GROUP BY 1) d ON d.m = s.period")
MONTHLY = VALUED.format(spine=SPINE, trunc="date_trunc('month', o_orderdate)",
                        agg="sum(o_totalprice)", f=GAPPY_SQL)


@entry(book, "trend", f'SELECT period, value, n AS "rows" FROM ({MONTHLY})', "value", 2)
def _(t):
    return tm.trend(gappy(t), "revenue", "month")


@entry(book, "trend_split", f"""
WITH d AS (SELECT o_orderpriority AS member, date_trunc('month', o_orderdate)::DATE AS m,
 sum(o_totalprice) AS v, count(*) AS n FROM {GAPPY_SQL} GROUP BY 1, 2)
SELECT s.period, 'member' AS series, k.member, d.v AS value, coalesce(d.n, 0) AS "rows" FROM {SPINE} s,
 (SELECT DISTINCT member FROM d) k LEFT JOIN d ON d.m = s.period AND d.member = k.member
UNION ALL SELECT period, 'all', NULL, value, n FROM ({MONTHLY})""", "value", 2)
def _(t):
    return tm.trend(gappy(t), "revenue", "month", "o_orderpriority")


@entry(book, "trend_week_median", f"""
SELECT s.g::DATE AS period, d.v AS value, coalesce(d.n, 0) AS "rows" FROM generate_series(
 date_trunc('week', TIMESTAMP '1996-01-01'), date_trunc('week', TIMESTAMP '1999-12-31'), INTERVAL 7 DAY)
 s(g) LEFT JOIN (SELECT date_trunc('week', o_orderdate) AS m, median(o_totalprice) AS v, count(*) AS n
 FROM {GAPPY_SQL} GROUP BY 1) d ON d.m = s.g""", "value")
def _(t):
    return tm.trend(gappy(t), "mid_price", "week")


@entry(book, "trend_ends", f"""
WITH c AS (SELECT * FROM ({MONTHLY}) WHERE n > 0)
SELECT min(period) AS first_period, max(period) AS last_period, arg_min(value, period) AS first_value,
 arg_max(value, period) AS last_value, arg_max(value, period) - arg_min(value, period) AS change
FROM c""", "first_value last_value change", 2)
def _(t):
    return tm.trend_ends(gappy(t), "revenue", "month")


def _season(name, pos, spine, trunc, grain):
    sql = VALUED.format(spine=spine, trunc=trunc, agg="sum(o_totalprice)", f=GAPPY_SQL)

    @entry(book, name, f"""
WITH c AS ({sql}) SELECT CAST({pos} AS INT) AS position, avg(value) AS mean,
 avg(value) / (SELECT avg(value) FROM c) AS index, count(value) AS observed,
 count(*) - count(value) AS absent, CAST(sum(n) AS BIGINT) AS "rows" FROM c GROUP BY 1""",
           "mean index", 6)
    def _(t):
        return tm.seasonality(gappy(t), "revenue", grain)


_season("seasonality", "month(period)", SPINE, "date_trunc('month', o_orderdate)", "month")
_season("seasonality_weekday", "isodow(period)",
        "(SELECT g::DATE AS period FROM generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1999-12-31',"
        " INTERVAL 1 DAY) s(g))", "o_orderdate", "day")
_season("seasonality_quarter", "quarter(period)",
        "(SELECT g::DATE AS period FROM generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1999-10-01',"
        " INTERVAL 3 MONTH) s(g))", "date_trunc('quarter', o_orderdate)", "quarter")


@entry(book, "period_compare", f"""
WITH g AS (SELECT year(o_orderdate) AS y, sum(o_totalprice) AS v, count(*) AS n,
 count(DISTINCT o_orderdate::DATE) AS dd FROM {GAPPY_SQL} WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1),
 w AS (SELECT max(v) FILTER (WHERE y = 1996) AS v0, max(v) FILTER (WHERE y = 1997) AS v1,
 max(n) FILTER (WHERE y = 1996) AS n0, max(n) FILTER (WHERE y = 1997) AS n1,
 max(dd) FILTER (WHERE y = 1996) AS d0, max(dd) FILTER (WHERE y = 1997) AS d1 FROM g)
SELECT v0 AS baseline_value, v1 AS period_value, n0 AS baseline_rows, n1 AS period_rows,
 d0 AS baseline_days, d1 AS period_days, v1 - v0 AS difference, (v1 - v0) / v0 * 100 AS percent FROM w""",
       "baseline_value period_value difference percent", 2)
def _(t):
    return tm.period_compare(gappy(t), "revenue", "1997", "1996", "year")


@entry(book, "period_compare_gaps", f"""
SELECT CAST(year(period) AS VARCHAR) AS label, period AS month FROM ({CAL})
WHERE n = 0 AND year(period) IN (1996, 1997)""")
def _(t):
    return tm.compared_empty_months(gappy(t), "1997", "1996", "year")


GROWTH = f"""
WITH g AS (SELECT o_custkey AS member,
 sum(o_totalprice) FILTER (WHERE quarter(o_orderdate) = 1) AS v0,
 sum(o_totalprice) FILTER (WHERE quarter(o_orderdate) = 3) AS v1 FROM {GAPPY_SQL}
 WHERE year(o_orderdate) = 1998 AND quarter(o_orderdate) IN (1, 3) GROUP BY 1),
 c AS (SELECT *, coalesce(v1, 0) - coalesce(v0, 0) AS ch FROM g)"""


@entry(book, "growth_decomposition", GROWTH + """
SELECT member, v0 AS baseline_value, v1 AS period_value, ch AS change,
 ch / (SELECT sum(ch) FROM c) AS share_of_change, v0 IS NULL AS entrant, v1 IS NULL AS leaver FROM c""",
       "baseline_value period_value change share_of_change", 2)
def _(t):
    return tm.growth_decomposition(gappy(t), "revenue", "o_custkey", "1998-Q3", "1998-Q1", "quarter")


@entry(book, "growth_summary", GROWTH + """
SELECT sum(ch) AS net, sum(abs(ch)) AS gross, count(*) FILTER (WHERE ch > 0) AS rose,
 count(*) FILTER (WHERE ch < 0) AS fell, count(*) FILTER (WHERE v0 IS NULL) AS entrants,
 count(*) FILTER (WHERE v1 IS NULL) AS leavers FROM c""", "net gross", 2)
def _(t):
    return tm.growth_summary(tm.growth_decomposition(
        gappy(t), "revenue", "o_custkey", "1998-Q3", "1998-Q1", "quarter"))


@entry(book, "mix_shift", f"""
WITH g AS (SELECT o_custkey AS member,
 avg(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997) AS m0,
 avg(o_totalprice) FILTER (WHERE year(o_orderdate) = 1998) AS m1,
 count(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997) AS n0,
 count(o_totalprice) FILTER (WHERE year(o_orderdate) = 1998) AS n1 FROM {ORDERS_SQL} GROUP BY 1),
 w AS (SELECT *, n0 / (SELECT sum(n0) FROM g) AS w0, n1 / (SELECT sum(n1) FROM g) AS w1 FROM g
 WHERE n0 > 0 OR n1 > 0)
SELECT member, m0 AS baseline_mean, m1 AS period_mean, w0 AS baseline_share, w1 AS period_share,
 w0 * (m1 - m0) AS rate, CASE WHEN m1 IS NOT NULL THEN m0 * (w1 - w0) END AS mix,
 (w1 - w0) * (m1 - m0) AS interaction, coalesce(w1 * m1, 0) - coalesce(w0 * m0, 0) AS contribution FROM w""",
       "baseline_mean period_mean baseline_share period_share rate mix interaction contribution")
def _(t):
    return tm.mix_shift(orders(t), "avg_price", "o_custkey", "1998", "1997", "year")
