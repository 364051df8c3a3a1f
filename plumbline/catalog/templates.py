"""Metric templates beyond sums and ratios (section 2.16): weighted means, levels, distinct counts that add up over time."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import Contract, Measure
from ..functions.aggs import declared
from ..functions.staging import stage
from ..operators import describe
from ..operators import templates as m
from ..operators.scope import Scope
from .base import entry

book: dict = {}

#: Lines whose weight is 0, or whose weight or value is missing, take no part.
WEIGHTED = Contract(name="lines", measures=(Measure("price", "weighted_mean", column="value", weight="weight"),), dimensions=("l_shipmode", "l_returnflag"))
WEIGHTED_SQL = """(SELECT l_returnflag, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS value,
 CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS weight FROM lineitem)"""


def _weighted(t) -> Scope:
    n = F.col("l_linenumber")
    return Scope.of(t("lineitem").select("l_returnflag", F.when(n != 3, F.col("l_extendedprice")).alias("value"),
                                         F.when(n == 1, 0.0).when(n != 2, F.col("l_quantity")).alias("weight")), WEIGHTED)


@entry(book, "tpl_weighted_mean", f"""
SELECT l_returnflag AS member, sum(value * weight) / nullif(sum(CASE WHEN value IS NOT NULL THEN weight END), 0) AS price
FROM {WEIGHTED_SQL} GROUP BY 1""", "price")
def _(t):
    scope = _weighted(t)
    return scope.df.groupBy(F.col("l_returnflag").alias("member")).agg(declared(WEIGHTED.measure("price")).alias("price"))


@entry(book, "tpl_weighted_mean_compare", f"""
SELECT coalesce(l_returnflag, '') AS member, sum(value * weight) / nullif(sum(CASE WHEN value IS NOT NULL THEN weight END), 0) AS total
FROM {WEIGHTED_SQL} GROUP BY l_returnflag""", "total")
def _(t):
    out = describe.group_compare(_weighted(t), "l_returnflag", "price")
    return out.where(F.col("member").isNotNull()).select("member", "total")


#: What a customer's last order was worth stands until the next one.
LEVELS = Contract(name="orders", date_column="o_orderdate", measures=(Measure("open_value", "level", column="o_totalprice", per=("o_custkey",)),),
                  dimensions=("o_orderpriority",))


def _levels_sql(grain: str, by: str = "") -> str:
    keys, same = (f", {by}", f"AND a.{by} = b.{by}") if by else ("", "")
    return f"""
WITH d AS (SELECT DISTINCT date_trunc('{grain}', o_orderdate)::DATE AS p FROM orders),
 s AS (SELECT unnest(generate_series((SELECT min(p) FROM d), (SELECT max(p) FROM d), INTERVAL 1 {grain}))::DATE AS period),
 l AS (SELECT s.period{keys}, o_custkey, max(row(o_orderdate, o_totalprice)) AS last FROM s JOIN orders ON o_orderdate < s.period + INTERVAL 1 {grain} GROUP BY s.period, o_custkey{keys})
SELECT '{grain}' AS grain, period{keys}, sum(last[2]) AS level, count(*) AS units FROM l GROUP BY period{keys}"""


@entry(book, "tpl_semi_additive", f"SELECT * FROM ({_levels_sql('month')}) UNION ALL SELECT * FROM ({_levels_sql('quarter')})", "level", 2)
def _(t):
    # one state, two calendars
    changes = stage(m.level_changes(Scope.of(t("orders"), LEVELS), "open_value"))
    month, quarter = (m.levels(changes, g).select(F.lit(g).alias("grain"), "period", "level", "units") for g in ("month", "quarter"))
    return month.unionByName(quarter)


@entry(book, "tpl_semi_additive_split", _levels_sql("quarter", "o_orderpriority"), "level", 2)
def _(t):
    changes = stage(m.level_changes(Scope.of(t("orders"), LEVELS), "open_value", ("o_orderpriority",)))
    return m.levels(changes, "quarter", ("o_orderpriority",)).withColumn("grain", F.lit("quarter"))


def _grains(state: DataFrame) -> DataFrame:
    out = m.distinct_over(state).select(F.lit("all").alias("grain"), F.lit(None).cast("date").alias("period"), "distinct")
    for g in ("week", "month", "quarter", "year"):
        out = out.unionByName(m.distinct_over(state, F.trunc("day", g)).select(F.lit(g).alias("grain"), "period", "distinct"))
    return out


def _grains_sql(value: str) -> str:
    parts = [f"SELECT 'all' AS grain, NULL::DATE AS period, count(DISTINCT {value}) AS \"distinct\" FROM orders"]
    parts += [f"SELECT '{g}', date_trunc('{g}', o_orderdate)::DATE, count(DISTINCT {value}) FROM orders GROUP BY 1, 2" for g in ("week", "month", "quarter", "year")]
    return " UNION ALL ".join(parts)


@entry(book, "tpl_distinct", _grains_sql("o_custkey"))
def _(t):
    return _grains(stage(m.distinct_state(t("orders"), "o_orderdate", "o_custkey")))


@entry(book, "tpl_distinct_text", _grains_sql("o_orderpriority || o_custkey"))
def _(t):
    df = t("orders").withColumn("who", F.concat("o_orderpriority", F.col("o_custkey").cast("string")))
    ids = m.numbered(df, "who")
    return _grains(stage(m.distinct_state(df.join(ids, df["who"] == ids["value"]), "o_orderdate", "id")))
