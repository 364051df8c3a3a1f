"""Tables with known faults, derived row by row from the given ones in Spark and in SQL alike."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TODAY = "2002-01-01"

#: orders with one fault family per column; every row of the table is kept.
DIRTY_SQL = """(SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS stage,
 CASE WHEN o_orderkey % 101 = 0 THEN 'N/A' WHEN o_orderkey % 103 = 0 THEN 'unknown'
  WHEN o_orderkey % 107 = 0 THEN '   ' WHEN o_orderkey % 149 = 0 THEN 'Total' ELSE o_orderpriority END AS priority,
 CASE WHEN o_orderkey % 109 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS status,
 CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS amount,
 CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS payer,
 CASE WHEN o_orderstatus <> 'O' OR o_orderkey % 151 = 0 THEN o_totalprice END AS fee,
 CASE WHEN o_orderkey % 113 = 0 THEN -o_totalprice ELSE o_totalprice END AS net,
 CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS text_day,
 CASE WHEN o_orderkey % 127 = 0 THEN DATE '2031-05-01' ELSE o_orderdate::DATE END AS order_date,
 CASE WHEN o_orderkey % 131 = 0 THEN o_orderdate::DATE - 2 ELSE o_orderdate::DATE + 3 END AS shipped_date,
 CASE o_orderkey % 3 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency,
 CASE WHEN o_orderkey % 137 = 0 THEN 1.5::DOUBLE ELSE (o_orderkey % 100) / 100.0::DOUBLE END AS discount_rate,
 CASE WHEN o_orderkey % 139 = 0 THEN 120.0::DOUBLE ELSE (o_orderkey % 90)::DOUBLE END AS drop_lat,
 CASE WHEN o_orderkey % 139 = 0 THEN 45.0::DOUBLE WHEN o_orderkey % 90 = 0 THEN 0.0::DOUBLE
  ELSE (o_orderkey % 180)::DOUBLE END AS drop_lng FROM orders)"""


def dirty(t) -> DataFrame:
    k, s, p = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_totalprice")
    d = F.col("o_orderdate").cast("date")

    def every(n: int):
        return k % n == 0

    return t("orders").select(
        k.alias("order_id"), F.col("o_custkey").alias("customer_id"), s.alias("stage"),
        F.when(every(101), "N/A").when(every(103), "unknown").when(every(107), "   ")
        .when(every(149), "Total").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(every(109), F.lower(s)).otherwise(s).alias("status"),
        F.when(s != "P", p).alias("amount"), F.when(s != "P", F.col("o_custkey")).alias("payer"),
        F.when((s != "O") | every(151), p).alias("fee"),
        F.when(every(113), -p).otherwise(p).alias("net"),
        F.when(every(3), F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
        .alias("text_day"),
        F.when(every(127), F.lit("2031-05-01").cast("date")).otherwise(d).alias("order_date"),
        F.when(every(131), F.date_sub(d, 2)).otherwise(F.date_add(d, 3)).alias("shipped_date"),
        F.when(every(3), "INR").when(k % 3 == 1, "USD").otherwise("EUR").alias("currency"),
        F.when(every(137), 1.5).otherwise((k % 100) / 100.0).alias("discount_rate"),
        F.when(every(139), 120.0).otherwise((k % 90).cast("double")).alias("drop_lat"),
        F.when(every(139), 45.0).when(every(90), 0.0).otherwise((k % 180).cast("double"))
        .alias("drop_lng"))


#: orders whose keys repeat and go missing, and whose customers do not all exist.
FAULTY_SQL = """(SELECT CASE WHEN o_orderkey % 211 = 0 THEN NULL WHEN o_orderkey % 197 = 0 THEN o_orderkey + 1
  ELSE o_orderkey END AS order_id, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS part,
 CASE WHEN o_orderkey % 223 = 0 THEN NULL WHEN o_orderkey % 227 = 0 THEN -5 ELSE o_custkey END AS customer_id,
 CASE WHEN o_orderkey % 229 = 0 THEN 'X' WHEN o_orderkey % 233 = 0 THEN NULL ELSE o_orderstatus END AS status,
 CASE WHEN o_orderkey % 239 = 0 THEN NULL ELSE o_orderdate::DATE END AS order_date,
 CASE WHEN o_orderkey % 241 = 0 THEN NULL WHEN o_orderkey % 251 = 0 THEN -1.0::DOUBLE ELSE o_totalprice END AS price
 FROM orders)"""


def faulty(t) -> DataFrame:
    k = F.col("o_orderkey")

    def every(n: int):
        return k % n == 0

    return t("orders").select(
        F.when(every(211), F.lit(None)).when(every(197), k + 1).otherwise(k).alias("order_id"),
        F.when(every(7), 2).otherwise(1).alias("part"),
        F.when(every(223), F.lit(None)).when(every(227), F.lit(-5)).otherwise(F.col("o_custkey"))
        .alias("customer_id"),
        F.when(every(229), "X").when(every(233), F.lit(None)).otherwise(F.col("o_orderstatus"))
        .alias("status"),
        F.when(~every(239), F.col("o_orderdate").cast("date")).alias("order_date"),
        F.when(every(241), F.lit(None)).when(every(251), F.lit(-1.0))
        .otherwise(F.col("o_totalprice")).alias("price"))


#: text columns as people export them, from orders; each is one reading problem.
TEXTS_SQL = """(SELECT o_orderkey,
 CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' WHEN o_orderkey % 89 = 0 THEN '0042' ELSE CAST(o_custkey AS VARCHAR) END AS code,
 CASE WHEN o_orderkey % 83 = 0 THEN 'not priced' ELSE CAST(o_totalprice AS VARCHAR) END AS price,
 CASE WHEN o_orderkey % 79 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:30:00'
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS stamp,
 CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS flag,
 '₹' || CAST(o_custkey % 1000 AS VARCHAR) || ',000.50' AS money,
 CASE WHEN o_orderkey % 73 = 0 THEN ' ' || o_orderpriority || ' ' WHEN o_orderkey % 71 = 0 THEN lower(o_orderpriority)
  ELSE o_orderpriority END AS label,
 CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS mixed_day,
 CAST(o_custkey % 100 AS VARCHAR) || ',5%' AS pct,
 CASE WHEN o_orderkey % 67 = 0 THEN '(' || CAST(o_custkey AS VARCHAR) || ',25)' ELSE '1.' ||
  lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || ',75' END AS eu,
 CASE WHEN o_orderkey % 61 = 0 THEN 'infinity'::DOUBLE ELSE o_totalprice END AS reading FROM orders)"""


def texts(t) -> DataFrame:
    k, c, p = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.col("o_totalprice")
    d = F.col("o_orderdate")
    pr = F.col("o_orderpriority")

    def every(n: int):
        return k % n == 0

    iso = F.date_format(d, "yyyy-MM-dd")
    return t("orders").select(
        "o_orderkey", F.when(every(97), "n/a").when(every(89), "0042").otherwise(c).alias("code"),
        F.when(every(83), "not priced").otherwise(p.cast("string")).alias("price"),
        F.when(every(79), F.concat(iso, F.lit(" 10:30:00"))).otherwise(iso).alias("stamp"),
        F.when(every(2), "true").otherwise("false").alias("flag"),
        F.concat(F.lit("₹"), (F.col("o_custkey") % 1000).cast("string"), F.lit(",000.50")).alias("money"),
        F.when(every(73), F.concat(F.lit(" "), pr, F.lit(" "))).when(every(71), F.lower(pr))
        .otherwise(pr).alias("label"),
        F.when(every(2), F.date_format(d, "dd/MM/yyyy")).otherwise(iso).alias("mixed_day"),
        F.concat((F.col("o_custkey") % 100).cast("string"), F.lit(",5%")).alias("pct"),
        F.when(every(67), F.concat(F.lit("("), c, F.lit(",25)"))).otherwise(
            F.concat(F.lit("1."), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"),
                     F.lit(",75"))).alias("eu"),
        F.when(every(61), F.lit(float("inf"))).otherwise(p).alias("reading"))
