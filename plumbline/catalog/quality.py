"""Data-quality rules (section 2.13)."""

from pyspark.sql import functions as F

from ..operators import quality as q
from ..operators.temporal import growth_decomposition
from .base import entry
from .planted import DIRTY_SQL, TODAY, dirty
from .temporal import GROWTH, gappy

book: dict = {}

HELD = ("'unknown','n/a','na','none','null','nil','-','--','?','missing','not available','tbd','#n/a','(blank)',"
        "'undefined','not known','(not set)','not set','(not provided)','not provided','(unknown)'")


@entry(book, "dq_placeholder", f"""SELECT 'M1' AS rule, 'priority' AS "column", count(*) AS "rows", trim(priority) AS detail
FROM {DIRTY_SQL} WHERE lower(trim(priority)) IN ({HELD}) GROUP BY trim(priority)""")
def _(t):
    return q.dq_placeholder(dirty(t))


@entry(book, "dq_blank", f"""
WITH d AS (SELECT * FROM {DIRTY_SQL}),
 c AS (SELECT count(*) FILTER (WHERE amount IS NULL AND payer IS NULL) AS ab, count(*) FILTER (WHERE amount IS NULL) AS a,
 count(*) FILTER (WHERE payer IS NULL) AS p, count(*) FILTER (WHERE stage = 'P') AS st,
 count(*) FILTER (WHERE fee IS NULL) AS f, count(*) FILTER (WHERE trim(priority) = '') AS pr FROM d)
SELECT 'M2' AS rule, 'amount,payer' AS "column", a AS "rows", CASE WHEN st = a THEN 'stage = P' END AS detail FROM c
 WHERE ab = a AND a = p UNION ALL SELECT 'M2', 'fee', f, NULL FROM c UNION ALL SELECT 'M2', 'priority', pr, NULL FROM c""")
def _(t):
    return q.dq_blank(dirty(t), explain=["stage", "currency"])


@entry(book, "dq_near_miss", f"""
SELECT 'M14' AS rule, 'fee' AS "column", b AS "rows", 'stage = O (+' || (n - b) || ')' AS detail FROM (SELECT
 count(*) FILTER (WHERE fee IS NULL) AS b, count(*) FILTER (WHERE stage = 'O') AS n, count(*) AS r FROM {DIRTY_SQL})
WHERE n - b > 0 AND n - b <= 0.01 * r""")
def _(t):
    return q.dq_near_miss(dirty(t), ["stage", "currency"])


@entry(book, "dq_negative", f"""
SELECT 'M3' AS rule, 'net' AS "column", count(*) FILTER (WHERE net < 0) AS "rows",
 CASE WHEN count(*) FILTER (WHERE net < 0) <= 0.05 * count(net) THEN 'error' ELSE 'signed' END AS detail FROM {DIRTY_SQL}""")
def _(t):
    return q.dq_negative(dirty(t))


@entry(book, "dq_text_dates", f"""
SELECT 'M4' AS rule, 'text_day' AS "column", count(text_day) - count(TRY_CAST(text_day AS DATE)) AS "rows", NULL::VARCHAR AS detail
FROM {DIRTY_SQL} HAVING count(TRY_CAST(text_day AS DATE)) >= 0.5 * count(text_day)""")
def _(t):
    return q.dq_text_dates(dirty(t))


@entry(book, "dq_empty_months", """
WITH d AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders WHERE month(o_orderdate) <> 2),
 a AS (SELECT unnest(generate_series((SELECT min(m) FROM d), (SELECT max(m) FROM d), INTERVAL 1 MONTH))::DATE AS m)
SELECT 'M5' AS rule, 'o_orderdate' AS "column", 0::BIGINT AS "rows", strftime(m, '%Y-%m') AS detail FROM a
WHERE m NOT IN (SELECT m FROM d)""")
def _(t):
    dated = F.when(F.month("o_orderdate") != 2, F.col("o_orderdate"))
    return q.dq_empty_months(t("orders").withColumn("o_orderdate", dated), "o_orderdate", TODAY)


@entry(book, "dq_subtotals", f"""SELECT 'M6' AS rule, 'priority' AS "column", count(*) AS "rows", trim(priority) AS detail
FROM {DIRTY_SQL} WHERE lower(trim(priority)) IN ('total','grand total','subtotal','sub total','all','overall')
GROUP BY trim(priority)""")
def _(t):
    return q.dq_subtotals(dirty(t))


@entry(book, "dq_coordinates", f"""
WITH c AS (SELECT count(*) FILTER (WHERE abs(drop_lat) > 90) AS a, count(*) FILTER (WHERE abs(drop_lng) > 180) AS b,
 count(*) FILTER (WHERE abs(drop_lat) > 90 AND abs(drop_lat) <= 180 AND abs(drop_lng) <= 90) AS s,
 count(*) FILTER (WHERE drop_lat = 0 AND drop_lng = 0) AS z FROM {DIRTY_SQL})
SELECT * FROM (SELECT 'M7' AS rule, 'drop_lat' AS "column", a AS "rows", 'out_of_range' AS detail FROM c
 UNION ALL SELECT 'M7', 'drop_lng', b, 'out_of_range' FROM c UNION ALL SELECT 'M7', 'drop_lat,drop_lng', s, 'swapped' FROM c
 UNION ALL SELECT 'M7', 'drop_lat,drop_lng', z, 'zero' FROM c) WHERE "rows" > 0""")
def _(t):
    return q.dq_coordinates(dirty(t))


@entry(book, "dq_spellings", f"""
SELECT 'M8' AS rule, 'status' AS "column", count(*) AS "rows", string_agg(DISTINCT status, ' / ' ORDER BY status) AS detail
FROM {DIRTY_SQL} GROUP BY lower(trim(status)) HAVING count(DISTINCT status) > 1""")
def _(t):
    return q.dq_spellings(dirty(t), ["status", "priority"])


@entry(book, "dq_over_whole", f"""
SELECT 'M9' AS rule, 'discount_rate' AS "column", count(*) FILTER (WHERE discount_rate > 1) AS "rows", '1' AS detail
FROM {DIRTY_SQL} HAVING count(*) FILTER (WHERE discount_rate <= 1) >= 0.99 * count(discount_rate)""")
def _(t):
    return q.dq_over_whole(dirty(t))


SPLIT_SQL = ("(SELECT o_orderkey - o_orderkey % 2 AS visit_id, CASE WHEN o_orderkey % 10 = 1 THEN 'web' ELSE 'shop' END AS "
             "channel, o_totalprice FROM orders)")


@entry(book, "dq_split_id", f"""
WITH g AS (SELECT visit_id, count(DISTINCT channel) AS n FROM {SPLIT_SQL} GROUP BY 1)
SELECT 'M10' AS rule, 'visit_id' AS "column", count(*) FILTER (WHERE n > 1) AS "rows", 'channel' AS detail FROM g
HAVING count(*) FILTER (WHERE n > 1) <= 0.3 * count(*)""")
def _(t):
    k = F.col("o_orderkey")
    return q.dq_split_id(t("orders").select(
        (k - k % 2).alias("visit_id"), F.when(k % 10 == 1, "web").otherwise("shop").alias("channel"), "o_totalprice"))


@entry(book, "dq_future", f"""
SELECT 'M11' AS rule, 'order_date' AS "column", count(*) AS "rows", max(order_date)::VARCHAR AS detail FROM {DIRTY_SQL}
WHERE order_date > DATE '{TODAY}'""")
def _(t):
    return q.dq_future(dirty(t), TODAY)


@entry(book, "dq_currencies", f"""
SELECT 'M12' AS rule, c AS "column", n AS "rows", 'currency: ' || (SELECT string_agg(DISTINCT currency, ', ' ORDER BY currency)
 FROM {DIRTY_SQL}) AS detail FROM (SELECT 'amount' AS c, count(amount) AS n FROM {DIRTY_SQL} UNION ALL SELECT 'fee', count(fee)
 FROM {DIRTY_SQL})""")
def _(t):
    return q.dq_currencies(dirty(t))


@entry(book, "dq_date_order", f"""
WITH c AS (SELECT count(*) FILTER (WHERE shipped_date < order_date AND order_date < DATE '2031-01-01') AS w,
 count(*) AS n FROM {DIRTY_SQL} WHERE order_date < DATE '2031-01-01')
SELECT 'M13' AS rule, 'shipped_date' AS "column", w AS "rows", 'before order_date' AS detail FROM c WHERE w <= 0.01 * n""")
def _(t):
    known = F.when(F.col("order_date") < F.lit("2031-01-01").cast("date"), F.col("order_date"))
    return q.dq_date_order(dirty(t).select(known.alias("order_date"), "shipped_date"))


UTM_SQL = ("(SELECT CASE WHEN event_id % 31 = 0 THEN '(not set)' WHEN event_id % 29 = 0 THEN 'Google' ELSE 'google' END AS "
           "source, CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 41 = 0 THEN '(none)' ELSE event_type END AS medium FROM events)")


@entry(book, "dq_utm", f"""
SELECT 'utm_case_variants' AS rule, 'source' AS "column", count(*) AS "rows", string_agg(DISTINCT source, ' / ' ORDER BY source)
 AS detail FROM {UTM_SQL} GROUP BY lower(trim(source)) HAVING count(DISTINCT source) > 1 UNION ALL
SELECT 'utm_not_set', 'source', count(*), NULL FROM {UTM_SQL} WHERE lower(trim(source)) IN ('(not set)', 'not set', '(none)', '')
UNION ALL SELECT 'utm_missing_medium', 'medium', count(*), NULL FROM {UTM_SQL} WHERE medium IS NULL OR
 lower(trim(medium)) IN ('', '(not set)', '(none)')""")
def _(t):
    e = F.col("event_id")
    df = t("events").select(
        F.when(e % 31 == 0, "(not set)").when(e % 29 == 0, "Google").otherwise("google").alias("source"),
        F.when(e % 37 == 0, F.lit(None)).when(e % 41 == 0, "(none)").otherwise(F.col("event_type")).alias("medium"))
    return q.dq_utm(df, "source", "medium")


@entry(book, "dq_flag_conflict", """
WITH d AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'RTO' ELSE 'Delivered' END AS st, l_linenumber = 1 AS f FROM lineitem)
SELECT 'flag_conflict' AS rule, 'rto_flag' AS "column", count(*) FILTER (WHERE st = 'Delivered' AND f) AS "rows",
 'delivered but flagged' AS detail FROM d UNION ALL SELECT 'flag_conflict', 'rto_flag', count(*) FILTER (WHERE st = 'RTO' AND NOT f),
 'returned but not flagged' FROM d""")
def _(t):
    df = t("lineitem").select(F.when(F.col("l_returnflag") == "R", "RTO").otherwise("Delivered").alias("status"),
                              (F.col("l_linenumber") == 1).alias("rto_flag"))
    return q.dq_flag_conflict(df, "rto_flag", "status")


@entry(book, "dq_pii", """
SELECT * FROM (SELECT 'pii_value' AS rule, 'text' AS "column", count(*) FILTER (WHERE regexp_matches(text,
 '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS "rows", 'email' AS detail FROM documents
UNION ALL SELECT 'pii_value', 'text', count(*) FILTER (WHERE regexp_matches(text, '\\+?[0-9][0-9 ()-]{8,}[0-9]')), 'phone'
FROM documents) WHERE "rows" > 0""")
def _(t):
    return q.dq_pii(t("documents"), ["text"])


@entry(book, "dq_small_groups", """
WITH g AS (SELECT l_partkey AS member, count(*) AS n, sum(l_quantity) AS v FROM lineitem GROUP BY 1)
SELECT member, CASE WHEN n >= 25 THEN n END AS "rows", CASE WHEN n >= 25 THEN v END AS value, n < 25 AS suppressed FROM g""",
       "value", 2)
def _(t):
    return q.dq_small_groups(t("lineitem"), "l_partkey", F.sum("l_quantity"), 25)


@entry(book, "dq_offsetting", GROWTH + """
SELECT sum(ch) AS net, sum(abs(ch)) AS gross, count(*) FILTER (WHERE ch > 0) AS rose, count(*) FILTER (WHERE ch < 0) AS fell,
 count(*) FILTER (WHERE ch > 0) > 0 AND count(*) FILTER (WHERE ch < 0) > 0 AND abs(sum(ch)) <= 0.2 * sum(abs(ch)) AS offsetting
FROM c""", "net gross", 2)
def _(t):
    return q.dq_offsetting(growth_decomposition(gappy(t), "revenue", "o_custkey", "1998-Q3", "1998-Q1", "quarter"))


CAL = (("sale", "1996-11-20", "1996-12-05"), ("holiday", "1997-12-24", "1998-01-02"), ("change", "1999-03-15", "1999-03-15"))


@entry(book, "dq_context", f"""
WITH p AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS label, date_trunc('month', o_orderdate)::DATE AS s,
 (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS e FROM orders),
 c(event, cs, ce) AS (VALUES {", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in CAL)})
SELECT label, event, CAST(least(e, ce) - greatest(s, cs) + 1 AS BIGINT) AS days FROM p JOIN c ON cs <= e AND s <= ce""")
def _(t):
    d = F.col("o_orderdate").cast("date")
    periods = t("orders").select(F.date_format(d, "yyyy-MM").alias("label"), F.trunc(d, "month").alias("start"),
                                 F.last_day(d).alias("end")).distinct()
    cal = periods.sparkSession.range(1).select(F.inline(F.array(*[F.struct(
        F.lit(a).alias("event"), F.lit(b).cast("date").alias("start"), F.lit(c).cast("date").alias("end"))
        for a, b, c in CAL])))
    return q.dq_context(periods, cal)
