"""Tier 7 analyses (section 2.8)."""

from ..operators import people as p
from .base import entry, events, orders, ORDERS_SQL

book: dict = {}


def _cohort(name, grain, diff):
    @entry(book, name, f"""
WITH u AS (SELECT DISTINCT o_custkey AS k, date_trunc('{grain}', o_orderdate)::DATE AS p FROM {ORDERS_SQL}),
 f AS (SELECT k, min(p) AS cohort FROM u GROUP BY 1)
SELECT cohort, CAST({diff} AS INT) AS "offset", count(*) AS people FROM u JOIN f USING (k) GROUP BY 1, 2""")
    def _(t):
        return p.cohort_retention(orders(t), "o_custkey", grain)


_cohort("cohort_retention", "month", "date_diff('month', cohort, p)")
_cohort("cohort_retention_quarter", "quarter", "date_diff('quarter', cohort, p)")
_cohort("cohort_retention_week", "week", "date_diff('day', cohort, p) / 7")


@entry(book, "cohort_unplaced", """
SELECT count(*) FILTER (WHERE user_id IS NULL) AS no_entity,
 count(*) FILTER (WHERE user_id IS NOT NULL AND ts IS NULL) AS no_date FROM events""")
def _(t):
    return p.unplaced(events(t), "user_id")


@entry(book, "repeat_behaviour", f"""
WITH e AS (SELECT o_custkey AS k, count(*) AS n FROM {ORDERS_SQL} GROUP BY 1),
 b AS (SELECT CASE WHEN n = 1 THEN 'once' WHEN n = 2 THEN 'twice' WHEN n = 3 THEN 'three times'
  WHEN n <= 5 THEN 'four or five times' ELSE 'more than 5 times' END AS how_often, n FROM e)
SELECT how_often, count(*) AS people, count(*) / (SELECT count(*) FROM e) AS share,
 CAST(sum(n) AS BIGINT) AS events FROM b GROUP BY 1""", "share", 6)
def _(t):
    return p.repeat_behaviour(orders(t), "o_custkey")


GAPS = """
WITH e AS ({e}), o AS (SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY d) AS seq,
  lag(d) OVER (PARTITION BY k ORDER BY d) AS pd FROM e),
 n AS (SELECT k, count(*) AS n FROM e GROUP BY 1)
SELECT (SELECT count(*) FROM n) AS people, (SELECT count(*) FROM n WHERE n > 1) AS repeaters,
 (SELECT avg(CAST(n > 1 AS INT)) FROM n) AS repeat_rate,
 (SELECT median(date_diff('day', pd, d)) FROM o WHERE seq = 2)::DOUBLE AS median_first_gap,
 (SELECT median(date_diff('day', pd, d)) FROM o WHERE seq > 1)::DOUBLE AS median_gap"""


@entry(book, "repeat_gaps", GAPS.format(e=f"SELECT o_custkey AS k, o_orderdate::DATE AS d FROM {ORDERS_SQL}"),
       "repeat_rate median_first_gap median_gap", 6)
def _(t):
    return p.repeat_gaps(orders(t), "o_custkey")


@entry(book, "repeat_gaps_by_event", GAPS.format(
    e="SELECT l_suppkey AS k, min(l_shipdate)::DATE AS d FROM lineitem GROUP BY l_suppkey, l_orderkey"),
       "repeat_rate median_first_gap median_gap", 6)
def _(t):
    # an order's lines from one supplier are one event
    from .base import lines
    return p.repeat_gaps(lines(t), "l_suppkey", "l_orderkey")
