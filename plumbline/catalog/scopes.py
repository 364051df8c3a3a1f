"""Scope algebra, joins and declared aggregates (inventory sections 2.2 to 2.4)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..contract import Contract, Exclusion, Measure, Window as Span
from ..functions.aggs import (declared, finite, non_finite_count, row_hash_sum, sample_kurtosis,
                              sample_skewness)
from ..functions.quantiles import grouped, null_safe_join
from ..operators import presets_filters as pf
from ..operators.scope import Scope, checked_predicate, scope_counts
from .base import (EVENTS_SQL, LINES_SQL, ORDERS, ORDERS_SQL, entry, events_table, lines,
                   orders)

book: dict = {}

# orders with planted gaps: every 11th date and every 13th status is missing
GAPS_SQL = ("(SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, "
            "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, "
            "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders)")


def gaps(t):
    o, k = t("orders"), F.col("o_orderkey")
    return o.withColumns({
        "o_orderstatus": F.when(k % 13 != 0, F.col("o_orderstatus")),
        "o_orderdate": F.when(k % 11 != 0, F.col("o_orderdate"))})


INSIDE = "(o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1999-12-31' + INTERVAL 1 DAY)"


@entry(book, "scope_counts", f"""
SELECT count(*) AS "rows", count(*) FILTER (WHERE ex) AS excluded,
 count(*) FILTER (WHERE NOT ex AND NOT inw) AS outside_window,
 count(*) FILTER (WHERE NOT ex AND inw IS NULL) AS no_date,
 count(*) FILTER (WHERE NOT ex AND inw) AS analysed,
 count(*) FILTER (WHERE NOT ex AND unk) AS rule_unknown
FROM (SELECT coalesce(o_orderstatus = 'P', false) AS ex, (o_orderstatus = 'P') IS NULL AS unk,
 {INSIDE} AS inw FROM {GAPS_SQL})""")
def _(t):
    return scope_counts(gaps(t), ORDERS)


@entry(book, "scope_window", f"""
SELECT count(*) AS n, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day
FROM orders WHERE {INSIDE}""")
def _(t):
    s = Scope.of(t("orders"), Contract("orders", date_column="o_orderdate",
                                       window=Span("1996-01-01", "1999-12-31")))
    d = F.col("o_orderdate").cast("date")
    return s.df.agg(F.count("*").alias("n"), F.min(d).alias("first_day"), F.max(d).alias("last_day"))


@entry(book, "scope_exclude", f"""
SELECT o_orderstatus AS status, count(*) AS n FROM {GAPS_SQL}
WHERE NOT coalesce(o_orderstatus = 'P', false) AND NOT coalesce(o_totalprice < 1000, false)
GROUP BY 1""")
def _(t):
    c = Contract("orders", exclusions=(Exclusion("o_orderstatus = 'P'"),
                                       Exclusion("o_totalprice < 1000")))
    return Scope.of(gaps(t), c).df.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("n"))


@entry(book, "scope_where", f"""
SELECT count(*) AS n, sum(o_totalprice) AS revenue FROM {GAPS_SQL}
WHERE coalesce(o_orderstatus = 'F' AND o_totalprice > 250000, false)""", "revenue", 2)
def _(t):
    s = Scope(gaps(t), ORDERS).where("o_orderstatus = 'F' AND o_totalprice > 250000")
    return s.df.agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("revenue"))


@entry(book, "scope_groups", f"""
SELECT o_orderpriority AS member, count(*) AS n FROM {ORDERS_SQL}
WHERE CAST(o_orderpriority AS VARCHAR) IN ('1-URGENT', '2-HIGH') GROUP BY 1""")
def _(t):
    s = orders(t).groups("o_orderpriority", ["1-URGENT", "2-HIGH"])
    return s.df.groupBy(F.col("o_orderpriority").alias("member")).agg(F.count("*").alias("n"))


@entry(book, "scope_period", f"""
SELECT count(*) AS n, sum(o_totalprice) AS revenue FROM {ORDERS_SQL}
WHERE date_trunc('quarter', o_orderdate) = DATE '1997-04-01'""", "revenue", 2)
def _(t):
    return orders(t).period("1997-Q2", "quarter").df.agg(
        F.count("*").alias("n"), F.sum("revenue").alias("revenue"))


PER_ORDER = Contract("lines_of_orders", date_column="o_orderdate",
                     measures=(Measure("o_totalprice", "sum", per=("l_orderkey",)),),
                     dimensions=("o_orderpriority", "l_returnflag"))


def joined_lines(t):
    l = t("lineitem").select("l_orderkey", "l_returnflag")
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"])


@entry(book, "scope_unit", """
SELECT o_orderpriority AS member, count(*) AS units, sum(o_totalprice) AS total FROM (
 SELECT DISTINCT l_orderkey, o_orderpriority, o_totalprice FROM lineitem JOIN orders
 ON l_orderkey = o_orderkey) GROUP BY 1""", "total", 2)
def _(t):
    s = Scope(joined_lines(t), PER_ORDER).units(["o_totalprice"], ["o_orderpriority"],
                                                optional=["l_returnflag"])
    return s.df.groupBy(F.col("o_orderpriority").alias("member")).agg(
        F.count("*").alias("units"), F.sum("o_totalprice").alias("total"))


@entry(book, "pred_guard", """
SELECT count(*) AS n FROM lineitem WHERE coalesce(l_quantity > 10 AND l_returnflag <> 'A', false)""")
def _(t):
    df = t("lineitem")
    rule = checked_predicate(df, "l_quantity > 10 AND l_returnflag <> 'A'")
    return df.where(F.coalesce(rule, F.lit(False))).agg(F.count("*").alias("n"))


@entry(book, "proj_measures", f"""
SELECT l_returnflag AS flag, sum(disc_value) / nullif(sum(l_extendedprice), 0) AS discount_rate,
 avg(CAST(l_quantity > 25 AS INT)) AS bulk, sum(l_quantity) AS quantity
FROM {LINES_SQL} GROUP BY 1""", "discount_rate bulk quantity", 6)
def _(t):
    s = lines(t)
    return s.df.groupBy(F.col("l_returnflag").alias("flag")).agg(
        *[declared(s.contract.measure(m)).alias(m) for m in ("discount_rate", "bulk", "quantity")])


NONFINITE_SQL = ("(SELECT o_orderpriority, CASE WHEN o_orderkey % 17 = 0 THEN 'nan'::DOUBLE "
                 "WHEN o_orderkey % 19 = 0 THEN 'infinity'::DOUBLE ELSE o_totalprice END AS x FROM orders)")


def nonfinite(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderpriority", F.when(k % 17 == 0, F.lit(float("nan"))).when(
        k % 19 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice")).alias("x"))


@entry(book, "proj_finite", f"""
SELECT o_orderpriority AS member, count(*) FILTER (WHERE isfinite(x)) AS n,
 avg(x) FILTER (WHERE isfinite(x)) AS mean, count(*) FILTER (WHERE NOT isfinite(x)) AS set_aside
FROM {NONFINITE_SQL} GROUP BY 1""", "mean")
def _(t):
    df = nonfinite(t)
    return df.groupBy(F.col("o_orderpriority").alias("member")).agg(
        F.count(finite(df, "x")).alias("n"), F.avg(finite(df, "x")).alias("mean"),
        non_finite_count(df, "x").alias("set_aside"))


@entry(book, "filt_preset", """
SELECT o_orderpriority AS member, count(*) AS n FROM orders
WHERE NOT coalesce(regexp_matches(lower(o_orderpriority), 'not specified'), false)
 AND o_totalprice > 0 AND o_totalprice BETWEEN 1000 AND 400000
 AND o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '2000-06-30'
 AND regexp_matches(lower(o_orderstatus), 'f|o') AND o_orderdate::DATE > DATE '1995-06-01'
 AND o_orderdate::DATE <= DATE '2001-08-01' - INTERVAL 30 DAY GROUP BY 1""")
def _(t):
    steps = [{"exclude_matching": {"column": "o_orderpriority", "pattern": "not specified"}},
             {"require_positive": {"column": "o_totalprice"}},
             {"between": {"column": "o_totalprice", "low": 1000, "high": 400000}},
             {"date_range": {"column": "o_orderdate", "start": "1996-01-01", "end": "2000-06-30"}},
             {"keep_matching": {"column": "o_orderstatus", "pattern": "f|o"}},
             {"require_after": {"column": "o_orderdate", "date": "1995-06-01"}},
             {"older_than": {"column": "o_orderdate", "days": 30, "as_of": "2001-08-01"}}]
    return pf.filtered(t("orders"), steps).groupBy(F.col("o_orderpriority").alias("member")).agg(
        F.count("*").alias("n"))


@entry(book, "filt_flag", f"""
SELECT * FROM (SELECT 'flag_zero:is_click' AS flag, count(*) FILTER (WHERE is_click = 0) AS n,
 count(*) AS "rows" FROM {EVENTS_SQL} UNION ALL
 SELECT 'flag_rows:value > 200', count(*) FILTER (WHERE value > 200), count(*) FROM {EVENTS_SQL})""")
def _(t):
    return pf.flags(events_table(t), [{"flag_zero": "is_click"}, {"flag_rows": "value > 200"}])


@entry(book, "val_match", """
WITH typed(typed) AS (VALUES ('view'), ('Sign Up'), ('purch'), ('ERROR'), ('tap'), ('nothing')),
 vals AS (SELECT DISTINCT event_type AS value FROM events),
 alias(a, v) AS (VALUES ('tap', 'click')),
 c AS (SELECT typed, regexp_replace(lower(trim(typed)), '[\\s_-]+', '', 'g') AS k FROM typed),
 vc AS (SELECT value, regexp_replace(lower(trim(value)), '[\\s_-]+', '', 'g') AS k FROM vals)
SELECT c.typed, coalesce(
 (SELECT value FROM vals WHERE value = c.typed), (SELECT value FROM vc WHERE vc.k = c.k),
 (SELECT v FROM alias WHERE a = c.k),
 (SELECT CASE WHEN count(*) = 1 THEN min(value) END FROM vc WHERE contains(vc.k, c.k))) AS value
FROM c""")
def _(t):
    return pf.match_values(t("events"), "event_type",
                           ["view", "Sign Up", "purch", "ERROR", "tap", "nothing"],
                           {"tap": "click"})


@entry(book, "focus_worst", """
WITH g AS (SELECT l_suppkey AS m FROM lineitem GROUP BY 1 HAVING count(l_discount) >= 5
 ORDER BY avg(l_discount) DESC, m LIMIT 1)
SELECT l_returnflag AS flag, count(*) AS n, avg(l_quantity) AS mean_quantity FROM lineitem
WHERE l_suppkey = (SELECT m FROM g) GROUP BY 1""", "mean_quantity")
def _(t):
    s = pf.focus_worst(lines(t), "l_suppkey", "discount", min_group=5)
    return s.df.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count("*").alias("n"), F.avg("l_quantity").alias("mean_quantity"))


# --- joins -------------------------------------------------------------------------------------

@entry(book, "join_calendar_left", f"""
SELECT s.p::DATE AS period, coalesce(d.n, 0) AS "rows" FROM generate_series(
 TIMESTAMP '1996-01-01', TIMESTAMP '1999-12-01', INTERVAL 1 MONTH) s(p) LEFT JOIN (
 SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM {ORDERS_SQL}
 WHERE month(o_orderdate) <> 7 GROUP BY 1) d ON d.m = s.p""")
def _(t):
    from ..operators.periods import on_calendar, per_period
    s = orders(t)
    quiet = Scope(s.df.withColumn("o_orderdate", F.when(F.month("o_orderdate") != 7, F.col("o_orderdate"))), s.contract)
    return on_calendar(quiet, per_period(quiet, [F.count("*").alias("rows")], "month"), "month")


@entry(book, "join_self_event", """
WITH e AS (SELECT user_id AS k, ts::DATE AS d, row_number() OVER (PARTITION BY user_id
 ORDER BY ts, event_id) AS seq FROM events)
SELECT a.k AS user_id, date_diff('day', a.d, b.d) AS gap FROM e a JOIN e b ON a.k = b.k
AND a.seq = 1 AND b.seq = 2""")
def _(t):
    from ..functions.sequence import with_neighbours
    e = t("events").select("user_id", "ts", "event_id")
    rows = with_neighbours(e, ["user_id"], ["ts", "event_id"], following={"second": "ts"}, first="opens")
    return rows.where("opens AND second IS NOT NULL AND user_id IS NOT NULL").select(
        "user_id", F.datediff(F.col("second").cast("date"), F.col("ts").cast("date")).alias("gap"))


@entry(book, "join_self_event_gaps", """
SELECT user_id, event_id, date_diff('day', lag(ts) OVER w, ts) AS since, date_diff('day', ts, lead(ts) OVER w) AS until,
 lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(t):
    """Every event with the days since the user's last and until the next one."""
    from ..functions.sequence import with_neighbours
    e = t("events").select("user_id", "ts", "event_id", "event_type")
    rows = with_neighbours(e, ["user_id"], ["ts", "event_id"], following={"next_ts": "ts", "next_type": "event_type"}, preceding={"last_ts": "ts"})
    day = lambda c: F.col(c).cast("date")
    return rows.select("user_id", "event_id", F.datediff(day("ts"), day("last_ts")).alias("since"),
                       F.datediff(day("next_ts"), day("ts")).alias("until"), "next_type")


@entry(book, "join_cohort", """
SELECT f.co::DATE AS cohort, count(*) AS "rows", count(DISTINCT o_custkey) AS people FROM orders
JOIN (SELECT o_custkey AS c, date_trunc('month', min(o_orderdate)) AS co FROM orders GROUP BY 1) f
ON f.c = o_custkey GROUP BY 1""")
def _(t):
    from ..operators.periods import trunc_to
    o = t("orders")
    # rows collapse to one per customer before anything is joined or counted
    per = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.count("*").alias("n"))
    return per.groupBy(trunc_to("month", F.col("first")).alias("cohort")).agg(
        F.sum("n").alias("rows"), F.count("*").alias("people"))


@entry(book, "join_nullsafe", f"""
WITH s AS (SELECT o_orderstatus AS g, avg(o_totalprice) AS m FROM {GAPS_SQL} GROUP BY 1)
SELECT o.o_orderstatus AS member, count(*) AS "rows", count(*) FILTER (WHERE o_totalprice > m) AS above
FROM {GAPS_SQL} o JOIN s ON o.o_orderstatus IS NOT DISTINCT FROM s.g GROUP BY 1""")
def _(t):
    df = gaps(t).select(F.col("o_orderstatus").alias("member"), "o_totalprice")
    stats = df.groupBy("member").agg(F.avg("o_totalprice").alias("m"))
    return null_safe_join(df, stats, ["member"]).groupBy("member").agg(
        F.count("*").alias("rows"), F.count_if(F.col("o_totalprice") > F.col("m")).alias("above"))


@entry(book, "join_bucket", """
WITH e AS (SELECT l_suppkey AS e, sum(l_quantity) AS q, sum(l_extendedprice) AS p,
 avg(l_linenumber) AS pos FROM lineitem GROUP BY 1),
 b AS (SELECT *, CASE WHEN pos < 4 THEN 'low' ELSE 'high' END AS bk FROM e),
 x AS (SELECT bk, sum(p) / sum(q) AS rate FROM b GROUP BY 1)
SELECT e AS supplier, bk AS bucket, p / q AS own, rate FROM b JOIN x USING (bk)""", "own rate")
def _(t):
    e = t("lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(
        F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"),
        F.avg("l_linenumber").alias("pos"))
    b = e.withColumn("bucket", F.when(F.col("pos") < 4, "low").otherwise("high"))
    rates = b.groupBy("bucket").agg((F.sum("p") / F.sum("q")).alias("rate"))
    # two buckets: the rates side is two rows
    return b.join(F.broadcast(rates), "bucket").select(
        "supplier", "bucket", (F.col("p") / F.col("q")).alias("own"), "rate")


@entry(book, "join_bins", """
WITH v AS (SELECT DISTINCT l_quantity AS x FROM lineitem),
 b AS (SELECT x, ntile(7) OVER (ORDER BY x) AS bin FROM v)
SELECT bin, count(*) AS "rows", min(x) AS lo, max(x) AS hi FROM lineitem JOIN b ON l_quantity = x
GROUP BY 1""", "lo hi")
def _(t):
    from ..functions.quantiles import bucket_of
    from ..operators.relate import ntile_bounds
    df = t("lineitem").select(F.col("l_quantity").alias("x"))
    tops = ntile_bounds(df, "x", 7)
    # the bins are ranges of x, so the join on the value becomes a comparison with seven bounds
    return df.groupBy((bucket_of("x", tops) + 1).alias("bin")).agg(
        F.count("*").alias("rows"), F.min("x").alias("lo"), F.max("x").alias("hi"))


@entry(book, "join_anti", """
SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o
WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' AND o.o_totalprice > 300000)""")
def _(t):
    big = t("orders").where("o_orderstatus = 'F' AND o_totalprice > 300000")
    c = t("customer")
    return c.join(big, c["c_custkey"] == big["o_custkey"], "left_anti").select(
        "c_custkey", "c_mktsegment")


@entry(book, "join_calendar_anti", """
WITH p AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE dayofmonth(o_orderdate) <> 13)
SELECT s.d::DATE AS day FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01',
 INTERVAL 1 DAY) s(d) LEFT JOIN p ON p.d = s.d::DATE WHERE p.d IS NULL""")
def _(t):
    from ..operators.profile import missing_days
    dated = F.when(F.dayofmonth("o_orderdate") != 13, F.col("o_orderdate"))
    return missing_days(t("orders").withColumn("o_orderdate", dated), "o_orderdate")


@entry(book, "join_scalar_sub", """
WITH m(keyword, label) AS (VALUES ('view', 'browse'), ('click', 'browse'), ('purchase', 'buy'))
SELECT coalesce((SELECT label FROM m WHERE keyword = lower(trim(event_type))), '(ungrouped)') AS "group",
 count(*) AS n FROM events GROUP BY 1""")
def _(t):
    from ..operators.growth import with_group
    counts = t("events").groupBy("event_type").agg(F.count("*").alias("c"))
    spark = counts.sparkSession
    m = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("keyword"), F.lit(g).alias("group_label"))
        for k, g in (("view", "browse"), ("click", "browse"), ("purchase", "buy"))])))
    return with_group(counts, "event_type", m).groupBy("group").agg(F.sum("c").alias("n"))


@entry(book, "join_cross_scalar", """
SELECT l_suppkey AS member, avg(l_extendedprice) / (SELECT avg(l_extendedprice) FROM lineitem)
 AS index, count(*) AS n FROM lineitem GROUP BY 1""", "index", 6)
def _(t):
    l = t("lineitem")
    grand = l.agg(F.avg("l_extendedprice"))
    return l.groupBy(F.col("l_suppkey").alias("member")).agg(
        F.avg("l_extendedprice").alias("m"), F.count("*").alias("n")).select(
        "member", (F.col("m") / grand.scalar()).alias("index"), "n")


# --- declared aggregates ------------------------------------------------------------------------

def _declared(name, measure, sql_expr, digits=2, doubles="value"):
    @entry(book, name, f"SELECT o_orderpriority AS member, {sql_expr} AS value FROM {ORDERS_SQL} "
           f"GROUP BY 1", doubles, digits)
    def _(t):
        s = orders(t)
        m = s.contract.measure(measure)
        key = F.col("o_orderpriority").alias("member")
        if m.agg == "median":
            return grouped(s.df.select(key, measure), ["member"], [], {"value": (measure, 0.5)})
        return s.df.groupBy(key).agg(declared(m).alias("value"))


_declared("agg_sum", "revenue", "sum(o_totalprice)")
_declared("agg_mean", "avg_price", "avg(o_totalprice)", 4)
_declared("agg_median", "mid_price", "quantile_cont(o_totalprice, 0.5)", 4)
_declared("agg_min", "low_price", "min(o_totalprice)")
_declared("agg_max", "high_price", "max(o_totalprice)")
_declared("agg_count", "orders", "count(o_orderkey)", doubles="")
_declared("agg_count_distinct", "customers", "count(DISTINCT o_custkey)", doubles="")


@entry(book, "agg_ratio", f"""
SELECT l_suppkey AS member, sum(disc_value) / nullif(sum(l_extendedprice), 0) AS value
FROM {LINES_SQL} GROUP BY 1""", "value", 8)
def _(t):
    s = lines(t)
    return s.df.groupBy(F.col("l_suppkey").alias("member")).agg(
        declared(s.contract.measure("discount_rate")).alias("value"))


@entry(book, "agg_quantiles", """
SELECT l_returnflag AS member, count(l_extendedprice) AS n,
 quantile_cont(l_extendedprice, 0.0) AS q000, quantile_cont(l_extendedprice, 0.05) AS q005,
 quantile_cont(l_extendedprice, 0.25) AS q025, quantile_cont(l_extendedprice, 0.5) AS q050,
 quantile_cont(l_extendedprice, 0.75) AS q075, quantile_cont(l_extendedprice, 0.95) AS q095,
 quantile_cont(l_extendedprice, 1.0) AS q100 FROM lineitem GROUP BY 1""",
       "q000 q005 q025 q050 q075 q095 q100")
def _(t):
    from ..operators.describe import quantile_table
    return quantile_table(lines(t), "price", ["l_returnflag"]).withColumnRenamed(
        "l_returnflag", "member")


def _moment(name, spark_fn, sql_fn, digits=6):
    @entry(book, name, f"SELECT l_returnflag AS member, {sql_fn}(l_extendedprice / 1000) AS value "
           f"FROM lineitem GROUP BY 1", "value", digits)
    def _(t):
        x = F.col("l_extendedprice") / 1000
        return t("lineitem").groupBy(F.col("l_returnflag").alias("member")).agg(
            spark_fn(x).alias("value"))


_moment("agg_var", F.var_samp, "var_samp")
_moment("agg_std", F.stddev_samp, "stddev_samp")
_moment("agg_skew", lambda x: sample_skewness(x, F.count(x)), "skewness")
_moment("agg_kurt", lambda x: sample_kurtosis(x, F.count(x)), "kurtosis")


@entry(book, "agg_mad", """
WITH s AS (SELECT l_returnflag AS g, median(l_extendedprice) AS med FROM lineitem GROUP BY 1)
SELECT g AS member, median(abs(l_extendedprice - med)) AS mad FROM lineitem JOIN s
ON l_returnflag = g GROUP BY 1""", "mad")
def _(t):
    from ..operators.relate import outlier_bounds
    return outlier_bounds(lines(t), "price", "l_returnflag").select("member", "mad")


@entry(book, "agg_corr", """
SELECT l_returnflag AS member, corr(l_extendedprice, l_quantity) AS pearson FROM lineitem
GROUP BY 1""", "pearson", 8)
def _(t):
    from ..operators.relate import pearson_by
    return pearson_by(lines(t), "quantity", "price", "l_returnflag")


@entry(book, "agg_regr", """
SELECT l_returnflag AS member, regr_slope(l_extendedprice, l_quantity) AS slope,
 regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem GROUP BY 1""",
       "slope intercept")
def _(t):
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    varies = F.min(x) != F.max(x)
    return t("lineitem").groupBy(F.col("l_returnflag").alias("member")).agg(
        F.when(varies, F.regr_slope(y, x)).alias("slope"),
        F.when(varies, F.regr_intercept(y, x)).alias("intercept"))


@entry(book, "agg_filtered", """
SELECT l_returnflag AS member, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS f_qty,
 count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1""", "f_qty", 2)
def _(t):
    s = lines(t)
    return s.df.groupBy(F.col("l_returnflag").alias("member")).agg(
        declared(s.contract.measure("quantity"), F.col("l_linestatus") == "F").alias("f_qty"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@entry(book, "agg_grouping_sets", """
SELECT l_returnflag AS a, l_linestatus AS b, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT)
 AS gid, count(*) AS n, sum(l_quantity) AS q FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""", "q", 2)
def _(t):
    a, b = F.col("a"), F.col("b")
    df = t("lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"),
                              "l_quantity")
    return df.groupingSets([[a], [b], []], a, b).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@entry(book, "agg_list", """
WITH g AS (SELECT n_regionkey AS region, n_name AS m, n_nationkey AS v FROM nation)
SELECT region, string_agg(m, ' | ' ORDER BY v DESC) AS members, count(*) AS n FROM g GROUP BY 1""")
def _(t):
    # nation is a fixed list, five names to a region
    return t("nation").groupBy(F.col("n_regionkey").alias("region")).agg(
        F.expr("listagg(n_name, ' | ') WITHIN GROUP (ORDER BY n_nationkey DESC)").alias("members"),
        F.count("*").alias("n"))


@entry(book, "agg_argmax", """
SELECT o_custkey AS member, max(o_totalprice) AS top, arg_max(o_orderkey, o_totalprice) AS at
FROM orders GROUP BY 1""", "top", 2)
def _(t):
    return t("orders").groupBy(F.col("o_custkey").alias("member")).agg(
        F.max("o_totalprice").alias("top"), F.max_by("o_orderkey", "o_totalprice").alias("at"))


@entry(book, "agg_distinct_all", """
SELECT *, count(*) AS copies FROM (SELECT l_returnflag, l_linestatus, l_discount, l_tax
 FROM lineitem) GROUP BY ALL""", "l_discount l_tax")
def _(t):
    cols = ["l_returnflag", "l_linestatus", "l_discount", "l_tax"]
    return t("lineitem").groupBy(*cols).agg(F.count("*").alias("copies"))


@entry(book, "agg_tuple_distinct", f"""
SELECT count(*) AS tuples FROM (SELECT DISTINCT o_orderstatus, o_orderdate FROM {GAPS_SQL})""")
def _(t):
    return gaps(t).agg(F.count_distinct(F.struct("o_orderstatus", "o_orderdate")).alias("tuples"))


@entry(book, "agg_row_hash", """
SELECT 'lineitem' AS "table", count(*) AS "rows", true AS same_when_reordered FROM lineitem""")
def _(t):
    df = t("lineitem")
    a = df.agg(F.count("*").alias("rows"), row_hash_sum(df).alias("h"))
    b = df.repartition("l_partkey").agg(row_hash_sum(df).alias("h"))
    return a.select(F.lit("lineitem").alias("table"), "rows",
                    (F.col("h") == b.scalar()).alias("same_when_reordered"))


@entry(book, "agg_none", f"""
SELECT o_orderpriority AS member, count(*) AS "rows", count(o_orderkey) AS held FROM {ORDERS_SQL}
GROUP BY 1""")
def _(t):
    # a measure that declares no aggregate gets counts, never a total
    s = orders(t)
    return s.df.groupBy(F.col("o_orderpriority").alias("member")).agg(
        F.count("*").alias("rows"), F.count("o_orderkey").alias("held"))


# --- windows of section 2.19 that no operator above names ----------------------------------------

@entry(book, "win_ranks", """
WITH h AS (SELECT l_quantity AS v, count(*) AS ties FROM lineitem GROUP BY 1)
SELECT v AS value, ties, sum(ties) OVER (ORDER BY v) - (ties - 1) / 2.0 AS midrank FROM h""",
       "value midrank")
def _(t):
    from ..functions.ranks import midranks
    return midranks(t("lineitem").select(F.col("l_quantity").alias("value")), "value")


@entry(book, "win_islands", """
WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE o_totalprice > 450000),
 r AS (SELECT d, d - CAST(row_number() OVER (ORDER BY d) AS INT) AS g FROM d)
SELECT min(d) AS first_day, count(*) AS days FROM r GROUP BY g""")
def _(t):
    dated = F.when(F.col("o_totalprice") > 450000, F.col("o_orderdate").cast("date"))
    d = t("orders").select(dated.alias("d")).where("d IS NOT NULL")
    # one row per calendar day
    w = Window.orderBy("d")
    runs = d.distinct().withColumn("g", F.date_sub("d", F.row_number().over(w)))
    return runs.groupBy("g").agg(F.min("d").alias("first_day"), F.count("*").alias("days")).drop("g")


@entry(book, "win_topk_nulls_last", f"""
SELECT o_orderkey, o_orderdate::DATE AS day FROM {GAPS_SQL}
ORDER BY o_orderdate ASC NULLS LAST, o_orderkey LIMIT 25""")
def _(t):
    return gaps(t).orderBy(F.asc_nulls_last("o_orderdate"), "o_orderkey").limit(25).select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
