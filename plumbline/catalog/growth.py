"""Tier 9 analyses (section 2.9)."""

from pyspark.sql import functions as F

from ..contract import Contract, Measure
from ..operators import growth as g
from ..operators.scope import Scope
from .base import EVENTS_SQL, LINES_SQL, entry, events, lines, orders, ORDERS_SQL

book: dict = {}

STEPS = ["view", "click", "signup", "purchase"]


@entry(book, "funnel", """
WITH e AS (SELECT user_id AS k, min(ts) FILTER (WHERE event_type = 'view') AS s0,
 min(ts) FILTER (WHERE event_type = 'click') AS s1, min(ts) FILTER (WHERE event_type = 'signup') AS s2,
 min(ts) FILTER (WHERE event_type = 'purchase') AS s3 FROM events GROUP BY 1),
 f AS (SELECT s0 IS NOT NULL AS r0,
  s0 IS NOT NULL AND s1 >= s0 AND s1 <= s0 + INTERVAL 7 DAY AS r1,
  s2 >= s1 AND s2 <= s0 + INTERVAL 7 DAY AS a2, s3 >= s2 AND s3 <= s0 + INTERVAL 7 DAY AS a3 FROM e),
 n AS (SELECT count(*) FILTER (WHERE r0) AS n0, count(*) FILTER (WHERE r1) AS n1,
  count(*) FILTER (WHERE r1 AND a2) AS n2, count(*) FILTER (WHERE r1 AND a2 AND a3) AS n3 FROM f)
SELECT 0 AS position, 'view' AS step, n0 AS entities, NULL::DOUBLE AS from_previous,
 n0 / nullif(n0, 0) AS from_first, NULL::BIGINT AS dropped FROM n
UNION ALL SELECT 1, 'click', n1, n1 / nullif(n0, 0), n1 / nullif(n0, 0), n0 - n1 FROM n
UNION ALL SELECT 2, 'signup', n2, n2 / nullif(n1, 0), n2 / nullif(n0, 0), n1 - n2 FROM n
UNION ALL SELECT 3, 'purchase', n3, n3 / nullif(n2, 0), n3 / nullif(n0, 0), n2 - n3 FROM n""",
       "from_previous from_first", 6)
def _(t):
    return g.funnel(events(t), "user_id", "event_type", STEPS, 7)


@entry(book, "source_reconciliation", f"""
SELECT event_type AS member, sum(value) AS value, count(event_id) AS events, sum(is_click) AS clicks,
 sum(value) / nullif(count(event_id), 0) AS value_vs_events, count(event_id) / nullif(count(event_id), 0)
 AS events_vs_events, sum(is_click) / nullif(count(event_id), 0) AS clicks_vs_events
FROM {EVENTS_SQL} GROUP BY 1""",
       "value events clicks value_vs_events events_vs_events clicks_vs_events", 5)
def _(t):
    return g.source_reconciliation(events(t), ["value", "events", "clicks"], "events", "event_type")


@entry(book, "ab_test", f"""
WITH v AS (SELECT variant, sum(is_purchase) AS x, sum(one)::DOUBLE AS n FROM {EVENTS_SQL} GROUP BY 1),
 a AS (SELECT * FROM v WHERE variant = 0), b AS (SELECT * FROM v WHERE variant = 1),
 s AS (SELECT a.x AS xa, a.n AS na, b.x AS xb, b.n AS nb FROM a, b),
 p AS (SELECT *, (xa + xb) / (na + nb) AS pp FROM s)
SELECT '0' AS variant_a, '1' AS variant_b, na AS trials_a, nb AS trials_b, xa / na AS rate_a,
 xb / nb AS rate_b, (na - (na + nb) / 2) ** 2 / ((na + nb) / 2) * 2 AS srm_chi2, xb / nb - xa / na AS effect,
 (xb / nb - xa / na) / sqrt(pp * (1 - pp) * (1 / na + 1 / nb)) AS z,
 (1.959963984540054 + 0.8416212335729143) * sqrt(pp * (1 - pp) * (1 / na + 1 / nb)) AS mde FROM p""",
       "trials_a trials_b rate_a rate_b srm_chi2 effect z mde", 7)
def _(t):
    return g.ab_test(events(t), "variant", "conversion").drop("verdict", "p", "srm_p")


@entry(book, "pacing", """
WITH m AS (SELECT * FROM events WHERE ts::DATE BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'),
 a AS (SELECT sum(value) AS s, max(ts::DATE) AS e FROM m),
 k AS (SELECT s, CAST(e - DATE '2024-01-01' AS INT) + 1 AS d FROM a)
SELECT 500000.0 AS budget, s AS spent, s / 500000 AS budget_share, d AS days_elapsed, 31 AS days_in_month,
 d / 31 AS month_share, s / d * 31 AS projected, s / d * 31 / 500000 - 1 AS projected_vs_budget FROM k""",
       "budget spent budget_share month_share projected projected_vs_budget")
def _(t):
    return g.pacing(events(t), "value", 500_000, "2024-01")


@entry(book, "marginal_returns", f"""
WITH d AS (SELECT o_orderdate::DATE AS day, sum(o_totalprice) AS s, count(o_orderkey)::DOUBLE AS o FROM {ORDERS_SQL}
 GROUP BY 1), b AS (SELECT *, ntile(5) OVER (ORDER BY s, day) AS band FROM d),
 x AS (SELECT band, count(*) AS days, min(s) AS lo, max(s) AS hi, avg(s) AS avg_spend, avg(o) AS avg_outcome,
 sum(s) / nullif(sum(o), 0) AS cost FROM b GROUP BY 1),
 y AS (SELECT *, avg_spend - lag(avg_spend) OVER (ORDER BY band) AS ds,
 avg_outcome - lag(avg_outcome) OVER (ORDER BY band) AS dd FROM x),
 z AS (SELECT CAST(band AS INT) AS band, days, lo, hi, avg_spend, avg_outcome, cost,
 CASE WHEN dd > 0 THEN ds / dd END AS marginal FROM y)
SELECT *, coalesce(band = (SELECT min(band) FROM z WHERE band > 1 AND (marginal IS NULL OR marginal > 200000)),
 false) AS crosses_target FROM z""", "lo hi avg_spend avg_outcome cost marginal", 5)
def _(t):
    return g.marginal_returns(orders(t), "revenue", "orders", 5, 200_000)


TEXTS = Contract("documents", measures=(Measure("n_chars", "sum"),), dimensions=("text", "source"))


def _ngrams(n):
    grams = ("w" if n == 1 else "list_transform(range(1, greatest(len(w) - %d, 1)), "
             "lambda i: array_to_string(w[i:i + %d], ' '))" % (n - 2, n - 1))
    name = "text_ngrams" if n == 1 else f"text_ngrams_{n}"

    @entry(book, name, f"""
WITH d AS (SELECT doc_id, n_chars AS v, list_filter(string_split(regexp_replace(lower(trim(text)),
 '[^a-z0-9ऀ-ॿ]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, v, unnest({grams}) AS ngram FROM d)
SELECT ngram, sum(v)::DOUBLE AS total, count(*) AS "rows" FROM g WHERE ngram <> '' GROUP BY 1
ORDER BY total DESC, ngram LIMIT 30""", "total", 0)
    def _(t):
        return g.text_ngrams(Scope.of(t("documents"), TEXTS), "text", "n_chars", n, 30)


for _n in (1, 2, 3):
    _ngrams(_n)


@entry(book, "key_overlap", """
WITH g AS (SELECT l_partkey AS k, CAST(l_suppkey AS VARCHAR) AS m, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
 t AS (SELECT k, sum(v) AS tot, max(v) AS top FROM g GROUP BY 1),
 b AS (SELECT g.k, tot, top, m, v FROM g JOIN t USING (k) WHERE v >= 0.1 * tot)
SELECT k AS key, count(*) AS splitters, any_value(tot) AS total, any_value(top) / any_value(tot) AS top_share,
 string_agg(m, ' | ' ORDER BY v DESC, m) AS members FROM b GROUP BY 1 HAVING count(*) >= 2
ORDER BY total DESC, key LIMIT 30""", "total top_share", 5)
def _(t):
    return g.key_overlap(lines(t), "l_partkey", "l_suppkey", "quantity", 0.1, 30)


@entry(book, "key_overlap_members", """
WITH g AS (SELECT l_partkey AS k, CAST(l_suppkey AS VARCHAR) AS m, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
 t AS (SELECT k, sum(v) AS tot FROM g GROUP BY 1),
 b AS (SELECT g.k, any_value(tot) AS tot FROM g JOIN t USING (k) WHERE v >= 0.1 * tot GROUP BY 1
  HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 30)
SELECT k AS key, m AS member, v AS total, v / tot AS share FROM g JOIN b USING (k)""", "total share", 5)
def _(t):
    s = lines(t)
    keys = g.key_overlap(s, "l_partkey", "l_suppkey", "quantity", 0.1, 30)
    return g.key_overlap_members(s, "l_partkey", "l_suppkey", "quantity", keys)


@entry(book, "expected_rate_by_bucket", f"""
WITH e AS (SELECT user_id AS e, sum(is_purchase)::DOUBLE AS n, sum(one)::DOUBLE AS d,
 sum(slot * one) / sum(one) AS p FROM {EVENTS_SQL} GROUP BY 1),
 b AS (SELECT *, CASE WHEN p < 2 THEN '1-1' WHEN p < 3 THEN '2-2' WHEN p < 4 THEN '3-3' WHEN p < 6 THEN '4-5'
 WHEN p < 11 THEN '6-10' WHEN p < 21 THEN '11-20' ELSE '21+' END AS bk FROM e),
 x AS (SELECT bk, sum(n) / sum(d) AS rate FROM b GROUP BY 1)
SELECT e AS entity, bk AS bucket, p AS position, n / d AS rate, x.rate AS expected, d AS weight,
 (x.rate - n / d) * d AS shortfall FROM b JOIN x USING (bk) WHERE d >= 40 AND n / d < x.rate
ORDER BY shortfall DESC, e LIMIT 30""", "position rate expected weight shortfall", 5)
def _(t):
    return g.expected_rate_by_bucket(events(t), "conversion", "slot", "user_id", min_weight=40)


@entry(book, "before_after_baseline", """
WITH t AS (SELECT o_orderdate::DATE AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1),
 pre AS (SELECT * FROM t WHERE d >= DATE '1998-06-01' - 28 AND d < DATE '1998-06-01'),
 post AS (SELECT * FROM t WHERE d >= DATE '1998-06-01' AND d < DATE '1998-06-01' + 28),
 a AS (SELECT (SELECT avg(v) FROM pre) AS pre_mean, (SELECT count(*) FROM pre) AS pre_n,
 (SELECT avg(v) FROM post) AS post_mean, (SELECT count(*) FROM post) AS post_n,
 (SELECT regr_intercept(v, d - DATE '1998-06-01') + regr_slope(v, d - DATE '1998-06-01') * 27 / 2.0 FROM pre) AS projected,
 (SELECT avg(v) FROM t WHERE d >= DATE '1998-06-01' - 364 AND d < DATE '1998-06-01' + 28 - 364) AS ly_post,
 (SELECT avg(v) FROM t WHERE d >= DATE '1998-06-01' - 28 - 364 AND d < DATE '1998-06-01' - 364) AS ly_pre)
SELECT pre_mean, pre_n, post_mean, post_n, projected, post_mean / projected - 1 AS vs_projection, ly_post,
 ly_post / ly_pre AS ly_lift, post_mean / (pre_mean * ly_post / ly_pre) - 1 AS vs_last_year FROM a""",
       "pre_mean post_mean projected vs_projection ly_post ly_lift vs_last_year", 5)
def _(t):
    from .base import ORDERS
    return g.before_after_baseline(Scope(t("orders").withColumn("revenue", F.col("o_totalprice")), ORDERS),
                                   "revenue", "1998-06-01")


SPEND = {"1996-01": 9_000_000.0, "1996-02": 30_000_000.0, "1996-04": 12_000_000.0, "1997-03": 1_000_000.0}
SPEND_SQL = ", ".join(f"('{m}', {a})" for m, a in SPEND.items())


@entry(book, "unit_economics", f"""
WITH o AS (SELECT o_custkey AS c, date_trunc('month', o_orderdate)::DATE AS mo, sum(o_totalprice) AS v
 FROM {ORDERS_SQL} GROUP BY 1, 2), f AS (SELECT c, min(mo) AS co FROM o GROUP BY 1),
 n AS (SELECT co, count(*) AS n FROM f GROUP BY 1), sp(m, a) AS (VALUES {SPEND_SQL}),
 k AS (SELECT f.co, date_diff('month', f.co, o.mo) AS k, sum(v) AS v FROM o JOIN f USING (c) GROUP BY 1, 2),
 r AS (SELECT k.co, k, n, sum(v / n) OVER (PARTITION BY k.co ORDER BY k) AS cum,
  (SELECT a FROM sp WHERE m = strftime(k.co, '%Y-%m')) / n AS cac FROM k JOIN n ON n.co = k.co),
 g AS (SELECT co, any_value(n) AS n, any_value(cac) AS cac, arg_max(cum, k) AS rev,
  min(k) FILTER (WHERE cum >= cac) + 1 AS pay FROM r GROUP BY 1)
SELECT co AS cohort, n AS customers, cac, rev AS revenue_per_customer, CAST(pay AS INT) AS payback_month,
 rev / cac AS ltv_to_cac, CAST(date_diff('month', co, (SELECT max(mo) FROM o)) + 1 AS INT) AS months_observed,
 date_diff('month', co, (SELECT max(mo) FROM o)) + 1 < 3 OR (cac IS NOT NULL AND pay IS NULL) AS immature
FROM g""", "cac revenue_per_customer ltv_to_cac", 4)
def _(t):
    return g.unit_economics(orders(t), "o_custkey", "revenue", SPEND)


@entry(book, "rate_mix_shift", f"""
WITH g AS (SELECT l_returnflag AS m, sum(disc_value) FILTER (WHERE year(l_shipdate) = 1997) AS n0,
 sum(l_extendedprice) FILTER (WHERE year(l_shipdate) = 1997) AS d0,
 sum(disc_value) FILTER (WHERE year(l_shipdate) = 1998) AS n1,
 sum(l_extendedprice) FILTER (WHERE year(l_shipdate) = 1998) AS d1 FROM {LINES_SQL} GROUP BY 1),
 w AS (SELECT *, n0 / d0 AS r0, n1 / d1 AS r1, d0 / sum(d0) OVER () AS w0, d1 / sum(d1) OVER () AS w1 FROM g),
 o AS (SELECT sum(n0) / sum(d0) AS o0, sum(n1) / sum(d1) AS o1, sum(w0 * (r1 - r0)) AS re,
 sum(r0 * (w1 - w0)) AS me, sum((w1 - w0) * (r1 - r0)) AS ie FROM w)
SELECT 'group' AS level, m AS member, r0 AS rate0, r1 AS rate1, w0 AS share0, w1 AS share1,
 w0 * (r1 - r0) AS rate_effect, r0 * (w1 - w0) AS mix_effect, (w1 - w0) * (r1 - r0) AS interaction,
 false AS simpson FROM w UNION ALL SELECT 'all', NULL, o0, o1, 1, 1, re, me, ie, re > 0 AND o1 < o0 FROM o""",
       "rate0 rate1 share0 share1 rate_effect mix_effect interaction", 8)
def _(t):
    return g.rate_mix_shift(lines(t), "discount_rate", "l_returnflag", "1998-01-01/1998-12-31",
                            "1997-01-01/1997-12-31")


def _group_map(t):
    """Keyword groups of part types: the map a person would have approved."""
    kind = F.lower(F.trim(F.col("p_type")))
    return t("part").select(kind.alias("keyword")).distinct().where(
        F.col("keyword") != "promo").select("keyword", F.when(
            F.col("keyword") < "m", "a to l").otherwise("m to z").alias("group_label"))


def _part_sales(t) -> Scope:
    p = t("part").select("p_partkey", "p_type", "p_brand")
    l = t("lineitem").select("l_partkey", "l_quantity", "l_shipdate")
    df = l.join(p, l["l_partkey"] == p["p_partkey"])
    return Scope(df, Contract("part_sales", date_column="l_shipdate",
                              measures=(Measure("l_quantity", "sum"),), dimensions=("p_type", "p_brand")))


SALES_SQL = ("(SELECT CASE WHEN lower(trim(p_type)) = 'promo' THEN '(ungrouped)' WHEN lower(trim(p_type)) < 'm' "
             "THEN 'a to l' ELSE 'm to z' END AS grp, p_type, p_brand, l_quantity, l_shipdate FROM lineitem "
             "JOIN part ON l_partkey = p_partkey)")


@entry(book, "group_map_totals", f"""
WITH g AS (SELECT grp, sum(l_quantity) AS v, count(DISTINCT lower(trim(p_type))) AS k FROM {SALES_SQL} GROUP BY 1)
SELECT grp AS "group", v AS total, k AS keywords, v / sum(v) OVER () AS share,
 sum(v) OVER (ORDER BY v DESC, grp ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS running_share FROM g""",
       "total share running_share", 6)
def _(t):
    return g.group_map_totals(_part_sales(t), "p_type", "l_quantity", _group_map(t))


@entry(book, "group_map_by_period", f"""
SELECT grp AS "group", date_trunc('quarter', l_shipdate)::DATE AS period, sum(l_quantity) AS total
FROM {SALES_SQL} GROUP BY 1, 2""", "total", 2)
def _(t):
    return g.group_map_totals(_part_sales(t), "p_type", "l_quantity", _group_map(t), grain="quarter")


@entry(book, "group_map_by_member", f"""
WITH m AS (SELECT grp, p_brand AS p, sum(l_quantity) AS v FROM {SALES_SQL} GROUP BY 1, 2)
SELECT grp AS "group", sum(v) AS total, count(*) AS members, max(v) / sum(v) AS top_share,
 arg_max(p, v) AS top_member FROM m GROUP BY 1""", "total top_share", 6)
def _(t):
    return g.group_map_totals(_part_sales(t), "p_type", "l_quantity", _group_map(t), member="p_brand")
