"""Domain presets (section 2.16) over advertising and shipment tables derived from the sales tables.

A preset of several steps is compared as one long frame (step, label, figure, value); a preset of one
step keeps the step's own columns.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runner import Request, figures, run_preset
from . import growth as g
from . import keywords as kw
from .base import EVENTS_SQL, ORDERS, entry, events_table, nudge, orders

book: dict = {}

ADS_SQL = """(SELECT l_shipdate::DATE AS day, l_returnflag AS channel, p_brand AS campaign, l_linestatus AS device,
 CAST(isodow(l_shipdate) AS INT) AS dow, l_linenumber AS hour, l_quantity * 40 AS impressions, l_quantity AS clicks,
 l_extendedprice AS spend, CAST(l_linenumber AS DOUBLE) AS conversions, l_extendedprice * (1 + l_tax) AS conv_value,
 l_extendedprice * (1 - l_discount) AS order_revenue, l_extendedprice * l_tax AS gst, p_size AS position, p_name AS query,
 p_brand AS page, p_type AS kind, l_quantity * 30 AS sent, l_quantity * 29 AS delivered, l_quantity * 9 AS opens,
 l_discount * 10 AS bounces, l_tax * 10 AS unsubscribes, l_discount AS lost_budget, l_tax AS lost_rank,
 l_linenumber = 1 AS cancelled, l_linenumber = 2 AS rto, l_partkey % 10 + 1 AS quality, l_suppkey AS customer,
 CASE WHEN l_linenumber = 7 THEN 'Test ' || p_brand ELSE p_brand END AS ad FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def ads(t) -> DataFrame:
    l = t("lineitem")
    p = t("part").select("p_partkey", "p_brand", "p_size", "p_name", "p_type")
    q, price, line = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_linenumber")
    return l.join(p, l["l_partkey"] == p["p_partkey"]).select(
        F.col("l_shipdate").cast("date").alias("day"), F.col("l_returnflag").alias("channel"),
        F.col("p_brand").alias("campaign"), F.col("l_linestatus").alias("device"),
        (F.weekday("l_shipdate") + 1).alias("dow"), line.alias("hour"), (q * 40).alias("impressions"),
        q.alias("clicks"), price.alias("spend"), line.cast("double").alias("conversions"),
        (price * (1 + F.col("l_tax"))).alias("conv_value"),
        (price * (1 - F.col("l_discount"))).alias("order_revenue"), (price * F.col("l_tax")).alias("gst"),
        F.col("p_size").alias("position"), F.col("p_name").alias("query"), F.col("p_brand").alias("page"),
        F.col("p_type").alias("kind"), (q * 30).alias("sent"), (q * 29).alias("delivered"), (q * 9).alias("opens"),
        (F.col("l_discount") * 10).alias("bounces"), (F.col("l_tax") * 10).alias("unsubscribes"),
        F.col("l_discount").alias("lost_budget"), F.col("l_tax").alias("lost_rank"),
        (line == 1).alias("cancelled"), (line == 2).alias("rto"), (F.col("l_partkey") % 10 + 1).alias("quality"),
        F.col("l_suppkey").alias("customer"),
        F.when(line == 7, F.concat(F.lit("Test "), F.col("p_brand"))).otherwise(F.col("p_brand")).alias("ad"))


SHIP_SQL = """(SELECT l_shipdate::DATE AS delivered_on, o_orderdate::DATE AS created_on, l_returnflag AS courier, l_linestatus AS zone,
 l_quantity AS minutes, 25 AS promised, CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'RTO' ELSE 'In transit' END AS status,
 l_linenumber AS attempts, CAST(o_orderstatus = 'O' AS INT) AS rto, o_orderpriority AS reason, l_quantity AS qty,
 l_quantity - CAST(l_linenumber = 7 AS INT) AS qty_out, l_discount * 100 AS km, CAST(l_tax * 100 AS INT) AS weather FROM lineitem
 JOIN orders ON l_orderkey = o_orderkey)"""


def shipments(t) -> DataFrame:
    l, o = t("lineitem"), t("orders")
    s = F.col("o_orderstatus")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.col("l_shipdate").cast("date").alias("delivered_on"), F.col("o_orderdate").cast("date").alias("created_on"),
        F.col("l_returnflag").alias("courier"), F.col("l_linestatus").alias("zone"), F.col("l_quantity").alias("minutes"),
        F.lit(25).alias("promised"), F.when(s == "F", "Delivered").when(s == "O", "RTO").otherwise("In transit")
        .alias("status"), F.col("l_linenumber").alias("attempts"), (s == "O").cast("int").alias("rto"),
        F.col("o_orderpriority").alias("reason"), F.col("l_quantity").alias("qty"),
        (F.col("l_quantity") - (F.col("l_linenumber") == 7).cast("int")).alias("qty_out"),
        (F.col("l_discount") * 100).alias("km"), F.round(F.col("l_tax") * 100).cast("int").alias("weather"))


# --- SQL of each analysis, written once and independently of the operators ---------------------------

def ratio(n: str, d: str, scale: float = 1) -> str:
    return f"{scale} * sum({n}) / nullif(sum({d}), 0)"


class Ratio(str):
    """An aggregate expression that has no value per row."""


def s_group(f, dim, value, agg="sum"):
    if isinstance(value, Ratio):
        cols = f"count(*) AS \"rows\", count(*) AS n, {value} AS total"
    else:
        cols = (f"count(*) AS \"rows\", count({value}) AS n, min({value}) AS min, max({value}) AS max, avg({value}) AS mean, "
                f"median({value}) AS median, stddev_samp({value}) AS stddev, {agg}({value}) AS total")
    both = (f"SELECT 'group' AS level, {dim}::VARCHAR AS member, {cols} FROM {f} GROUP BY 2 UNION ALL "
            f"SELECT 'all', NULL, {cols} FROM {f}")
    share = "" if isinstance(value, Ratio) or agg != "sum" else (
        ", total / sum(total) FILTER (WHERE level = 'group') OVER () AS share")
    return f"SELECT *{share} FROM ({both})", ["level", "member"]


def s_top(f, dim, value, n):
    return (f"SELECT {dim}::VARCHAR AS member, row_number() OVER (ORDER BY sum({value}) DESC, {dim}) AS rank, sum({value}) AS total, "
            f"count(*) AS \"rows\", sum({value}) / sum(sum({value})) OVER () AS share FROM {f} GROUP BY {dim} "
            f"ORDER BY total DESC, {dim} LIMIT {n}"), ["member"]


def s_pareto(f, dim, value):
    return (f"WITH g AS (SELECT {dim} AS member, sum({value}) AS total, count(*) AS n FROM {f} GROUP BY 1), r AS (SELECT *, "
            "row_number() OVER (ORDER BY total DESC, member) AS rank, total / sum(total) OVER () AS share, sum(total) OVER (ORDER BY "
            "total DESC, member ROWS UNBOUNDED PRECEDING) / sum(total) OVER () AS running_share FROM g) SELECT member, "
            "rank = (SELECT min(rank) FROM r WHERE round(running_share * 100, 9) >= 80) AS reaches, rank, total, n AS \"rows\", share, "
            "running_share FROM r"), ["member", "reaches"]


def s_trend(f, value, date="day", grain="week", spine_from=None):
    """``spine_from``: the rows the calendar spans, when the values come from fewer."""
    step = {"week": "7 DAY", "month": "1 MONTH"}[grain]
    return (f"WITH d AS (SELECT date_trunc('{grain}', {date})::DATE AS p, {value} AS value, count(*) AS n FROM {f} GROUP BY 1), "
            f"s AS (SELECT unnest(generate_series((SELECT min(p) FROM d), (SELECT max(p) FROM d), INTERVAL {step}))::DATE AS p) "
            "SELECT s.p AS period, value, coalesce(n, 0) AS \"rows\" FROM s LEFT JOIN d USING (p)"), ["period"]


def s_trend_split(f, value, dim, date="day"):
    one = s_trend(f, value, date)[0]
    return (f"WITH d AS (SELECT {dim} AS m, date_trunc('week', {date})::DATE AS p, {value} AS value, count(*) AS n FROM {f} GROUP BY 1, 2), "
            "s AS (SELECT unnest(generate_series((SELECT min(p) FROM d), (SELECT max(p) FROM d), INTERVAL 7 DAY))::DATE AS p) "
            "SELECT s.p AS period, 'member' AS series, k.m AS member, value, coalesce(n, 0) AS \"rows\" FROM s, (SELECT DISTINCT m FROM d) k "
            f"LEFT JOIN d ON d.p = s.p AND d.m = k.m UNION ALL SELECT period, 'all', NULL, value, \"rows\" FROM ({one})"), [
        "period", "series", "member"]


def s_period(f, value, p0, p1, date="day"):
    w = "strftime({d}, '%Y-%m') = '{p}'"
    a, b = w.format(d=date, p=p0), w.format(d=date, p=p1)
    one = (f"SELECT (SELECT {value} FROM {f} WHERE {a}) AS baseline_value, (SELECT {value} FROM {f} WHERE {b}) AS period_value, "
           f"(SELECT count(*) FROM {f} WHERE {a}) AS baseline_rows, (SELECT count(*) FROM {f} WHERE {b}) AS period_rows, "
           f"(SELECT count(DISTINCT {date}) FROM {f} WHERE {a}) AS baseline_days, (SELECT count(DISTINCT {date}) FROM {f} WHERE {b}) AS period_days")
    return (f"SELECT *, period_value - baseline_value AS difference, (period_value - baseline_value) / baseline_value * 100 AS percent "
            f"FROM ({one})"), []


def s_growth(f, dim, value, p0, p1, date="day"):
    return (f"WITH g AS (SELECT {dim} AS member, sum({value}) FILTER (WHERE strftime({date}, '%Y-%m') = '{p0}') AS baseline_value, "
            f"sum({value}) FILTER (WHERE strftime({date}, '%Y-%m') = '{p1}') AS period_value FROM {f} WHERE strftime({date}, '%Y-%m') IN "
            f"('{p0}', '{p1}') GROUP BY 1), c AS (SELECT *, coalesce(period_value, 0) - coalesce(baseline_value, 0) AS change FROM g) "
            "SELECT member, baseline_value IS NULL AS entrant, period_value IS NULL AS leaver, baseline_value, period_value, change, "
            "change / sum(change) OVER () AS share_of_change FROM c"), ["member", "entrant", "leaver"]


def s_cross(f, rows, cols, value):
    return (f"SELECT CASE WHEN grouping({rows}) = 0 AND grouping({cols}) = 0 THEN 'cell' WHEN grouping({rows}) = 0 THEN 'row_total' "
            f"WHEN grouping({cols}) = 0 THEN 'column_total' ELSE 'total' END AS kind, {rows}::VARCHAR AS row_member, {cols}::VARCHAR AS "
            f"column_member, {value} AS value, count(*) AS \"rows\" FROM {f} GROUP BY CUBE ({rows}, {cols})"), [
        "kind", "row_member", "column_member"]


def s_freq(f, col, limit):
    return (f"WITH c AS (SELECT {col} AS value, count(*) AS n FROM {f} GROUP BY 1), top AS (SELECT * FROM c ORDER BY n DESC, value LIMIT "
            f"{limit}), l AS (SELECT min(n) AS m FROM top) SELECT value::VARCHAR AS value, n AS \"rows\", n / (SELECT sum(n) FROM c) AS share, CASE WHEN n = m "
            "THEN (SELECT count(*) FROM c WHERE n = m) END AS tied_with_last FROM top, l"), ["value"]


def s_rate_bins(f, n, d, x, scale=1, bins=10):
    return (f"WITH v AS (SELECT DISTINCT {x} AS x FROM {f}), b AS (SELECT x, ntile({bins}) OVER (ORDER BY x) AS bin FROM v) "
            f"SELECT bin, min(x) AS x_from, max(x) AS x_to, count(*) AS \"rows\", {ratio(n, d, scale)} AS rate FROM {f} JOIN b ON {x} = x "
            "GROUP BY 1"), ["bin"]


def s_adequacy(f, dim, value):
    return (f"WITH g AS (SELECT {dim} AS m, count({value}) AS n, avg({value}) AS a, var_samp({value}) AS v FROM {f} GROUP BY 1), "
            "x AS (SELECT * FROM g ORDER BY m LIMIT 1), y AS (SELECT * FROM g ORDER BY m DESC LIMIT 1) SELECT x.n AS n1, y.n AS n2, "
            "sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2)) AS pooled_sd, x.a - y.a AS observed, 394 AS rows_for_2, "
            "64 AS rows_for_5, 26 AS rows_for_8 FROM x, y"), []


def long_sql(steps) -> str:
    """(title, (sql, labels), figure names) -> the long form, figures without a value left out."""
    parts = []
    for title, (sql, labels), names in steps:
        label = "concat_ws(' | ', " + ", ".join(f"CAST({x} AS VARCHAR)" for x in labels) + ")" if labels else "''"
        cols = ", ".join(f'CAST("{n}" AS DOUBLE) AS "{n}"' for n in names)
        on = ", ".join(f'"{n}"' for n in names)
        parts.append(f"SELECT '{title}' AS step, label, figure, round(value + {nudge(4)!r}, 4) + 0.0 AS value FROM (UNPIVOT (SELECT {label} AS label, {cols} "
                     f"FROM ({sql})) ON {on} INTO NAME figure VALUE value)")
    return " UNION ALL ".join(parts)


GROUP = ["rows", "n", "min", "max", "mean", "median", "stddev", "total", "share"]
MEAN = ["rows", "n", "min", "max", "mean", "median", "stddev", "total"]
RATE = ["rows", "n", "total"]
TOP = ["rank", "total", "rows", "share"]
PARETO = ["rank", "total", "rows", "share", "running_share"]
TREND = ["value", "rows"]
PERIOD = ["baseline_value", "period_value", "baseline_rows", "period_rows", "baseline_days", "period_days", "difference", "percent"]
GROWTH = ["baseline_value", "period_value", "change", "share_of_change"]
FREQ = ["rows", "share", "tied_with_last"]
BINS = ["x_from", "x_to", "rows", "rate"]
ADEQUATE = ["n1", "n2", "pooled_sd", "observed", "rows_for_2", "rows_for_5", "rows_for_8"]

ADS_BOUND = {"date": "day", "channel": "channel", "campaign": "campaign", "device": "device", "day_of_week": "dow", "hour": "hour",
             "impressions": "impressions", "clicks": "clicks", "spend": "spend", "conversions": "conversions", "conv_value": "conv_value",
             "order_revenue": "order_revenue", "gst": "gst", "position": "position", "query": "query", "page": "page"}
SHIP_BOUND = {"date": "created_on", "created_at": "created_on", "delivered_at": "delivered_on", "courier": "courier", "zone": "zone",
              "delivery_minutes": "minutes", "promised_minutes": "promised", "delivery_status": "status", "attempt_count": "attempts",
              "rto_flag": "rto", "failure_reason": "reason", "qty_ordered": "qty", "qty_delivered": "qty_out", "distance": "km",
              "weather": "weather"}


def pick(bound, *names, **more):
    return {**{n: bound[n] for n in names}, **more}


def preset(name, table, bindings, params=None, steps=None, sql=None, doubles="", digits=4, single=False, drop=()):
    """Register one preset; ``steps`` gives its long-form SQL, ``sql`` a single step's own."""
    key = "preset_" + name.split(".")[1]
    text = long_sql(steps) if steps else sql

    @entry(book, key, text, "" if steps else doubles, digits)
    def _(t):
        got = run_preset(name, Request(table(t), bindings, params or {}, **(
            {"group_map": g._group_map(t)} if "group" in name or "targeting" in name else {})))
        if single:
            return got[0].frame.drop(*drop)
        out = figures(got)
        return out.where(~F.col("figure").isin(*drop)) if drop else out


CLEAN = f"(SELECT * FROM {ADS_SQL} WHERE NOT regexp_matches(lower(ad), 'test|dummy|donotuse|do not use'))"
P = {"period": "1998-06", "baseline": "1998-03"}

preset("marketing.channel_efficiency", ads, pick(ADS_BOUND, "channel", "impressions", "clicks", "spend", "conversions", "conv_value",
                                                 campaign="ad"), steps=[
    ("Spend by group", s_top(CLEAN, "channel", "spend", 20), TOP),
    ("CTR", s_group(CLEAN, "channel", Ratio(ratio("clicks", "impressions", 100))), RATE),
    ("CPC", s_group(CLEAN, "channel", Ratio(ratio("spend", "clicks"))), RATE),
    ("CPA", s_group(CLEAN, "channel", Ratio(ratio("spend", "conversions"))), RATE),
    ("ROAS", s_group(CLEAN, "channel", Ratio(ratio("conv_value", "spend"))), RATE)])
preset("marketing.roas_change_explainer", ads, pick(ADS_BOUND, "date", "campaign", "spend", "conv_value"), P, steps=[
    ("ROAS then vs now", s_period(ADS_SQL, ratio("conv_value", "spend"), "1998-03", "1998-06"), PERIOD),
    ("Revenue change by group", s_growth(ADS_SQL, "campaign", "conv_value", "1998-03", "1998-06"), GROWTH),
    ("Spend change by group", s_growth(ADS_SQL, "campaign", "spend", "1998-03", "1998-06"), GROWTH)])
preset("marketing.spend_waste", ads, pick(ADS_BOUND, "campaign", "spend", "conversions"), steps=[
    ("Where the spend goes", s_pareto(ADS_SQL, "campaign", "spend"), PARETO),
    ("Conversions per group", s_group(ADS_SQL, "campaign", "conversions"), GROUP)])
preset("marketing.channel_mix_shift", ads, pick(ADS_BOUND, "date", "channel", "conversions", "clicks"), P, single=True, doubles=
       "rate0 rate1 share0 share1 rate_effect mix_effect interaction", digits=7, sql=f"""
WITH g AS (SELECT channel AS m, sum(conversions) FILTER (WHERE strftime(day, '%Y-%m') = '1998-03') * 100 AS n0,
 sum(clicks) FILTER (WHERE strftime(day, '%Y-%m') = '1998-03') AS d0, sum(conversions) FILTER (WHERE strftime(day, '%Y-%m') = '1998-06') * 100 AS n1,
 sum(clicks) FILTER (WHERE strftime(day, '%Y-%m') = '1998-06') AS d1 FROM {ADS_SQL} GROUP BY 1),
 w AS (SELECT *, n0 / d0 AS r0, n1 / d1 AS r1, d0 / sum(d0) OVER () AS w0, d1 / sum(d1) OVER () AS w1 FROM g),
 o AS (SELECT sum(n0) / sum(d0) AS o0, sum(n1) / sum(d1) AS o1, sum(w0 * (r1 - r0)) AS re, sum(r0 * (w1 - w0)) AS me,
 sum((w1 - w0) * (r1 - r0)) AS ie FROM w)
SELECT 'group' AS level, m AS member, r0 AS rate0, r1 AS rate1, w0 AS share0, w1 AS share1, w0 * (r1 - r0) AS rate_effect,
 r0 * (w1 - w0) AS mix_effect, (w1 - w0) * (r1 - r0) AS interaction, false AS simpson FROM w
UNION ALL SELECT 'all', NULL, o0, o1, 1, 1, re, me, ie, re > 0 AND o1 < o0 FROM o""")
preset("marketing.day_hour_performance", ads, pick(ADS_BOUND, "day_of_week", "hour", "spend"), steps=[
    ("Spend by day and hour", s_cross(ADS_SQL, "dow", "hour", "sum(spend)"), TREND)])
preset("marketing.device_geo_split", ads, pick(ADS_BOUND, "device", "clicks", "conversions"), steps=[
    ("Clicks by group", s_group(ADS_SQL, "device", "clicks"), GROUP),
    ("Conversion rate", s_group(ADS_SQL, "device", Ratio(ratio("conversions", "clicks", 100))), RATE),
    ("Is each group big enough", s_adequacy(ADS_SQL, "device", "clicks"), ADEQUATE)],
       drop=("detectable_d", "detectable_units"))
preset("marketing.creative_fatigue", ads, pick(ADS_BOUND, "date", "clicks", "impressions", frequency="position"), steps=[
    ("CTR as frequency rises", s_rate_bins(ADS_SQL, "clicks", "impressions", "position", 100), BINS),
    ("CTR by week", s_trend(ADS_SQL, ratio("clicks", "impressions", 100)), TREND)])
preset("marketing.landing_page_performance", ads, pick(ADS_BOUND, landing_page="page", sessions="impressions", engaged_sessions="clicks",
                                                       key_events="conversions"), steps=[
    ("Sessions", s_top(ADS_SQL, "page", "impressions", 25), TOP),
    ("Engagement rate", s_group(ADS_SQL, "page", Ratio(ratio("clicks", "impressions", 100))), RATE),
    ("Conversion rate", s_group(ADS_SQL, "page", Ratio(ratio("conversions", "impressions", 100))), RATE)])
preset("marketing.new_vs_returning", lambda t: t("orders"), {"user_pseudo_id": "o_custkey", "date": "o_orderdate"}, single=True,
       doubles="share", digits=6, sql="""
WITH e AS (SELECT o_custkey AS k, count(DISTINCT o_orderdate) AS n FROM orders GROUP BY 1),
 b AS (SELECT CASE WHEN n = 1 THEN 'once' WHEN n = 2 THEN 'twice' WHEN n = 3 THEN 'three times'
  WHEN n <= 5 THEN 'four or five times' ELSE 'more than 5 times' END AS how_often, n FROM e)
SELECT how_often, count(*) AS people, count(*) / (SELECT count(*) FROM e) AS share, CAST(sum(n) AS BIGINT) AS events FROM b GROUP BY 1""")


def between(a, b):
    return f"(SELECT * FROM {ADS_SQL} WHERE day BETWEEN DATE '{a}' AND DATE '{b}')"


preset("marketing.festive_compare", ads, pick(ADS_BOUND, "date", "channel", "order_revenue"), {
    "this_start": "1998-10-20", "this_end": "1998-11-05", "last_start": "1997-10-30", "last_end": "1997-11-14"}, steps=[
    ("This year", s_group(between("1998-10-20", "1998-11-05"), "channel", "order_revenue"), GROUP),
    ("Last year", s_group(between("1997-10-30", "1997-11-14"), "channel", "order_revenue"), GROUP)])
preset("marketing.seo_change_explainer", ads, pick(ADS_BOUND, "date", "page", "clicks", "impressions", "position"), P, steps=[
    ("Clicks change by group", s_growth(ADS_SQL, "page", "clicks", "1998-03", "1998-06"), GROWTH),
    ("Impressions", s_period(ADS_SQL, "sum(impressions)", "1998-03", "1998-06"), PERIOD),
    ("CTR", s_period(ADS_SQL, ratio("clicks", "impressions", 100), "1998-03", "1998-06"), PERIOD)])
preset("marketing.striking_distance", ads, pick(ADS_BOUND, "query", "position", "impressions"), steps=[
    ("Nearly on page one", s_top(f"(SELECT * FROM {ADS_SQL} WHERE position BETWEEN 4 AND 15)", "query", "impressions", 50), TOP)])
BRAND = "regexp_matches(lower(query), 'ring|hot')"
preset("marketing.brand_vs_nonbrand", ads, pick(ADS_BOUND, "date", "query", "clicks"), {"brand_terms": ["ring", "hot"]}, steps=[
    ("Brand", s_trend(f"(SELECT * FROM {ADS_SQL} WHERE {BRAND})", "sum(clicks)"), TREND),
    ("Non-brand", s_trend(f"(SELECT * FROM {ADS_SQL} WHERE NOT {BRAND})", "sum(clicks)"), TREND)])


def _splits_sql():
    from .relations import splits
    one = s_trend(ADS_SQL, "sum(clicks)")[0]
    return (f"WITH {splits(f'SELECT period, value, {chr(34)}rows{chr(34)} AS n FROM ({one})', 'a_')} SELECT period AS split_after, n0 AS before, n1 AS after, "
            "m0 AS mean_before, m1 AS mean_after, m1 - m0 AS difference, sep AS separation FROM a_c"), ["split_after"]


preset("marketing.content_decay", ads, pick(ADS_BOUND, "date", "page", "clicks"), steps=[
    ("Weekly clicks by page", s_trend_split(ADS_SQL, "sum(clicks)", "page"), TREND),
    ("When it changed", _splits_sql(), ["before", "after", "mean_before", "mean_after", "difference", "separation"])])
preset("marketing.email_performance", ads, pick(ADS_BOUND, "campaign", "clicks", sent="sent", delivered="delivered", opens="opens",
                                                unsubscribes="unsubscribes"), steps=[
    ("Click rate", s_group(ADS_SQL, "campaign", Ratio(ratio("clicks", "delivered", 100))), RATE),
    ("Click-to-open", s_group(ADS_SQL, "campaign", Ratio(ratio("clicks", "opens", 100))), RATE),
    ("Unsubscribe rate", s_group(ADS_SQL, "campaign", Ratio(ratio("unsubscribes", "delivered", 100))), RATE)])
preset("marketing.list_health", ads, pick(ADS_BOUND, "date", sent="sent", bounces="bounces", unsubscribes="unsubscribes",
                                          delivered="delivered"), steps=[
    ("Bounce rate", s_trend(ADS_SQL, ratio("bounces", "sent", 100)), TREND),
    ("Unsubscribe rate", s_trend(ADS_SQL, ratio("unsubscribes", "delivered", 100)), TREND)])
preset("marketing.social_post_performance", ads, pick(ADS_BOUND, "hour", post_type="kind", engagements="clicks", reach="impressions"), steps=[
    ("Engagement rate by type", s_group(ADS_SQL, "kind", Ratio(ratio("clicks", "impressions", 100))), RATE),
    ("By hour", s_cross(ADS_SQL, "kind", "hour", "sum(clicks)"), TREND)])
preset("marketing.impression_share_loss", ads, pick(ADS_BOUND, "campaign", lost_is_budget="lost_budget", lost_is_rank="lost_rank"), steps=[
    ("Lost to budget", s_top(ADS_SQL, "campaign", "lost_budget", 20), TOP),
    ("Lost to rank", s_top(ADS_SQL, "campaign", "lost_rank", 20), TOP)])
preset("marketing.quality_score_vs_cpc", ads, pick(ADS_BOUND, "spend", "clicks", quality_score="quality"), steps=[
    ("CPC by quality score", s_rate_bins(ADS_SQL, "spend", "clicks", "quality"), BINS)])
preset("marketing.utm_hygiene", ads, {"session_source": "channel", "session_medium": "query"}, steps=[
    ("Sources", s_freq(ADS_SQL, "channel", 50), FREQ), ("Mediums", s_freq(ADS_SQL, "query", 50), FREQ)])

# presets of one tier-9 analysis: the analysis has its own SQL, bound to the same columns here
EV = {"user_pseudo_id": "user_id", "event_name": "event_type", "date": "ts"}
preset("marketing.funnel", lambda t: t("events"), EV, {"steps": g.STEPS, "window_days": 7}, single=True, sql=g.book["funnel"][1], digits=6)
preset("marketing.conversion_reconciliation", lambda t: events_table(t).withColumns({"events": F.col("one"), "clicks": F.col("is_click")}),
       {"value": "value", "events": "events", "clicks": "clicks", "kind": "event_type"},
       {"sources": "value,clicks", "reference": "events", "by": "event_type"}, single=True, digits=5, doubles=
       "value events clicks value_vs_events events_vs_events clicks_vs_events", sql=f"""
SELECT event_type AS member, sum(value) AS value, sum(one) AS events, sum(is_click) AS clicks, sum(value) / sum(one) AS value_vs_events,
 sum(one) / sum(one) AS events_vs_events, sum(is_click) / sum(one) AS clicks_vs_events FROM {EVENTS_SQL} GROUP BY 1""")


@entry(book, "preset_ab_test_readout", g.book["ab_test"][1], digits=7)
def _(t):
    bound = {"variant": "variant", "conversions": "is_purchase", "clicks": "one"}
    r = Request(events_table(t), bound, {"rate_measure": "conversion"}, metrics={
        "conversion": {"n": ["conversions"], "d": ["clicks"]}})
    return run_preset("marketing.ab_test_readout", r)[0].frame.drop("verdict", "p", "srm_p")


preset("marketing.budget_pacing", lambda t: t("events"), {"spend": "value", "date": "ts"}, {"budget": 500_000, "month": "2024-01"},
       single=True, sql=g.book["pacing"][1])
preset("marketing.keyword_ngrams", lambda t: t("documents"), {"query": "text", "clicks": "n_chars"}, {"n": 2}, single=True,
       sql=g.book["text_ngrams_2"][1], digits=0)
preset("marketing.cannibalization", lambda t: t("lineitem"), {"query": "l_partkey", "page": "l_suppkey", "clicks": "l_quantity"},
       single=True, sql=g.book["key_overlap"][1], digits=5)
preset("marketing.ctr_vs_position", ads, pick(ADS_BOUND, "position", page="customer", clicks="conversions", impressions="opens"), single=True,
       doubles="position rate expected weight shortfall", digits=5, sql=f"""
WITH e AS (SELECT customer AS e, 100 * sum(conversions) AS n, sum(opens) AS d, sum(position * opens) / sum(opens) AS p FROM {ADS_SQL} GROUP BY 1),
 b AS (SELECT *, CASE WHEN p < 2 THEN '1-1' WHEN p < 3 THEN '2-2' WHEN p < 4 THEN '3-3' WHEN p < 6 THEN '4-5'
 WHEN p < 11 THEN '6-10' WHEN p < 21 THEN '11-20' ELSE '21+' END AS bk FROM e),
 x AS (SELECT bk, sum(n) / sum(d) AS rate FROM b GROUP BY 1)
SELECT e AS entity, bk AS bucket, p AS position, n / d AS rate, x.rate AS expected, d AS weight, (x.rate - n / d) * d AS shortfall
FROM b JOIN x USING (bk) WHERE d >= 100 AND n / d < x.rate ORDER BY shortfall DESC, e LIMIT 30""")
preset("marketing.campaign_impact", lambda t: t("orders"), {"order_revenue": "o_totalprice", "date": "o_orderdate"}, {"start": "1998-06-01"},
       single=True, sql=g.book["before_after_baseline"][1], digits=5)
preset("marketing.delivered_roas", ads, pick(ADS_BOUND, "order_revenue", "gst", "spend", payment_method="device", cancelled="cancelled",
                                             rto="rto"), steps=[
    ("Delivered ROAS", s_group(f"(SELECT * FROM {ADS_SQL} WHERE NOT cancelled AND NOT rto)", "device",
                               Ratio(ratio("order_revenue - gst", "spend"))), RATE)])
KEPT = {"customer_id": "o_custkey", "order_revenue": "o_totalprice", "date": "o_orderdate"}
preset("marketing.cac_payback", lambda t: orders(t, ORDERS).df, KEPT, {"spend": g.SPEND}, single=True, sql=g.book["unit_economics"][1], digits=4)
preset("marketing.ltv_to_cac", lambda t: orders(t, ORDERS).df, KEPT, {"spend": g.SPEND}, single=True, digits=4,
       sql=g.book["unit_economics"][1].replace("+ 1 < 3 OR", "+ 1 < 6 OR"))
preset("marketing.diminishing_returns", lambda t: orders(t, ORDERS).df.withColumn("conversions", F.lit(1)), {
    "spend": "o_totalprice", "conversions": "conversions", "date": "o_orderdate"}, {"target_cpa": 200_000}, single=True,
       sql=g.book["marginal_returns"][1], digits=5)
preset("marketing.keyword_grouping", kw.parts, {"query": "kw"}, single=True)
SOLD = {"query": "p_type", "page": "p_brand", "clicks": "l_quantity", "date": "l_shipdate"}
SALES = g.SALES_SQL
preset("marketing.keyword_group_performance", lambda t: g._part_sales(t).df, SOLD, steps=[
    ("By group", (f"WITH g AS (SELECT grp, sum(l_quantity) AS v, count(DISTINCT lower(trim(p_type))) AS k FROM {SALES} GROUP BY 1) SELECT "
                  'grp AS "group", v AS total, k AS keywords, v / sum(v) OVER () AS share, sum(v) OVER (ORDER BY v DESC, grp ROWS '
                  "UNBOUNDED PRECEDING) / sum(v) OVER () AS running_share FROM g", ['"group"']),
     ["total", "keywords", "share", "running_share"]),
    ("By week", (f"SELECT grp AS \"group\", date_trunc('week', l_shipdate)::DATE AS period, sum(l_quantity) AS total FROM {SALES} "
                 "GROUP BY 1, 2", ['"group"', "period"]), ["total"])])
preset("marketing.page_targeting", lambda t: g._part_sales(t).df, SOLD, single=True, sql=g.book["group_map_by_member"][1], digits=6)

OK = f"(SELECT * FROM {SHIP_SQL} WHERE status = 'Delivered' AND delivered_on > created_on)"
LATE = "CAST(minutes > promised AS INT)"
preset("logistics.sla_compliance", shipments, SHIP_BOUND, steps=[
    ("Breach rate", s_group(OK, "courier", LATE, "avg"), MEAN),
    ("Breach rate by week", s_trend(OK, f"avg({LATE})", "created_on"), TREND)])
WORST = (f"(SELECT * FROM {OK} WHERE courier = (SELECT courier FROM {OK} GROUP BY 1 HAVING count(*) >= 5 ORDER BY avg({LATE}) DESC, "
         "courier LIMIT 1))")
preset("logistics.sla_drivers", shipments, SHIP_BOUND, steps=[
    ("By weather", s_group(WORST, "weather", LATE, "avg"), MEAN),
    ("By attempts", s_group(WORST, "attempts", LATE, "avg"), MEAN),
    ("Distance when late", s_group(f"(SELECT * FROM {WORST} WHERE minutes > promised)", "courier", "km"), GROUP),
    ("Distance when on time", s_group(f"(SELECT * FROM {WORST} WHERE minutes <= promised)", "courier", "km"), GROUP)])
DONE = f"(SELECT * FROM {SHIP_SQL} WHERE status = 'Delivered')"
preset("logistics.otif", shipments, SHIP_BOUND, steps=[
    ("On time", s_group(OK, "courier", "CAST(minutes <= promised AS INT)", "avg"), MEAN),
    ("In full", s_group(DONE, "courier", "CAST(qty_out >= qty AS INT)", "avg"), MEAN),
    ("On time among in-full", s_group(f"(SELECT * FROM {OK} WHERE qty_out >= qty)", "courier", "CAST(minutes <= promised AS INT)", "avg"), MEAN)])
preset("logistics.courier_compare", shipments, {**SHIP_BOUND, "courier": "zone", "zone": "courier"}, steps=[
    ("Breach rate by courier", s_group(OK, "zone", LATE, "avg"), MEAN),
    ("Courier by zone", s_cross(OK, "zone", "courier", f"avg({LATE})"), TREND),
    ("Is each courier big enough", s_adequacy(OK, "zone", LATE), ADEQUATE)], drop=("detectable_d", "detectable_units"))
STUCK = f"(SELECT * FROM {SHIP_SQL} WHERE status = 'In transit' AND created_on <= DATE '2001-07-15' - 5)"
preset("logistics.stuck_shipments", shipments, SHIP_BOUND, {"as_of": "2001-07-15", "days": 5}, steps=[
    ("Stuck by group", s_freq(STUCK, "courier", 50), FREQ), ("Stuck by status", s_freq(STUCK, "status", 20), FREQ)])
preset("logistics.rto_analysis", shipments, SHIP_BOUND, steps=[
    ("RTO rate", s_group(SHIP_SQL, "courier", "CAST(rto = 1 AS INT)", "avg"), MEAN),
    ("RTO reasons", s_freq(f"(SELECT * FROM {SHIP_SQL} WHERE rto = 1)", "reason", 20), FREQ)])

