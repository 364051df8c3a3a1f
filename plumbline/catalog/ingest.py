"""Sources and sinks (section 2.1). Files are written by Spark from the tables, then read back."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profile import prof_columns
from ..sources import delimited as d
from ..sources import results as r
from .base import entry

book: dict = {}


def _as_text(t) -> DataFrame:
    """orders as export text: missing values written three ways, one price in words."""
    k = F.col("o_orderkey")
    return t("orders").select(
        k.cast("string").alias("Order ID"), F.when(k % 31 == 0, "NA").when(k % 37 == 0, " - ").otherwise(
            F.col("o_custkey").cast("string")).alias("Customer"),
        F.when(k % 41 == 0, "withheld").otherwise(F.col("o_totalprice").cast("string")).alias("Total Price"),
        F.date_format("o_orderdate", "dd/MM/yy").alias("Day"), k)


TEXT_SQL = """(SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 31 = 0 OR o_orderkey % 37 = 0 THEN NULL ELSE o_custkey END AS customer,
 CASE WHEN o_orderkey % 41 <> 0 THEN o_totalprice END AS total_price, strftime(o_orderdate, '%d/%m/%y') AS day FROM orders)"""
TYPES = {"order_id": "bigint", "customer": "bigint", "total_price": "double"}
NULLS = ("", "NA", "-")


def _write(df: DataFrame, header: bool, sep: str = ",") -> str:
    path = r.scratch(df.sparkSession, "export")
    df.write.option("header", str(header).lower()).option("sep", sep).option("emptyValue", "").csv(path)
    return path


def _file(t) -> str:
    return _write(_as_text(t).drop("o_orderkey"), True, ";")


@entry(book, "src_csv", f"SELECT order_id, customer, total_price, day FROM {TEXT_SQL}", "total_price", 2)
def _(t):
    path = _file(t)
    layout = d.Layout(delimiter=";", na_values=(*NULLS, "withheld"), dtypes=TYPES)
    return d.load(t("region").sparkSession, path, layout)


@entry(book, "src_csv_coerce", """
SELECT 'total_price' AS "column", 'double' AS type, count(*) FILTER (WHERE o_orderkey % 41 = 0) AS failed FROM orders
UNION ALL SELECT 'customer', 'bigint', 0 FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'order_id', 'bigint', 0 FROM region WHERE r_regionkey = 0""")
def _(t):
    raw = d.load(t("region").sparkSession, _file(t), d.Layout(delimiter=";", na_values=NULLS))
    return d.coercion_failures(raw, TYPES)


@entry(book, "src_csv_null_tokens", """
SELECT 'customer' AS "column", 'NA' AS token, count(*) AS "rows" FROM orders WHERE o_orderkey % 31 = 0 UNION ALL
SELECT 'customer', '-', count(*) FROM orders WHERE o_orderkey % 37 = 0 AND o_orderkey % 31 <> 0""")
def _(t):
    raw = d.load(t("region").sparkSession, _file(t), d.Layout(delimiter=";", na_values=()))
    return d.null_token_counts(raw, NULLS)


def _texts(t, text, name: str, **options) -> DataFrame:
    """documents.text written as a delimited file with quotes and read back."""
    df = t("documents").select("doc_id", text.alias("text"))
    path = r.scratch(df.sparkSession, name)
    (df.write.option("header", "true").option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false").csv(path))
    return d.load(df.sparkSession, path, d.Layout(na_values=(), dtypes={"doc_id": "bigint"}, **options))


@entry(book, "src_csv_quoted", """SELECT doc_id, CASE WHEN length(text) > 0 THEN replace(replace(text, chr(10), ' "" '), chr(13), ' ') END AS text FROM documents""")
def _(t):
    return _texts(t, F.regexp_replace(F.regexp_replace("text", "\n", ' "" '), "\r", " "), "quoted")


@entry(book, "src_csv_multiline", """SELECT doc_id, CASE WHEN length(text) > 0 THEN replace(text, chr(13), ' ') END AS text FROM documents""")
def _(t):
    return _texts(t, F.regexp_replace("text", "\r", " "), "multiline", multiline=True)


@entry(book, "src_csv_ragged", """
SELECT doc_id, n_chars, CASE WHEN doc_id % 100 = 99 THEN 'x' || doc_id END AS column_3 FROM documents""")
def _(t):
    df = t("documents")
    path = r.scratch(df.sparkSession, "ragged")
    df.select(F.concat_ws(",", "doc_id", "n_chars", F.when(F.col("doc_id") % 100 == 99, F.concat(F.lit("x"), "doc_id"))).alias("value")).write.text(path)
    return d.load(df.sparkSession, path, d.Layout(header_rows=0, names=("doc_id", "n_chars"), dtypes={"doc_id": "bigint", "n_chars": "bigint"}))


def _ordered(t) -> DataFrame:
    return t("orders").select("o_orderkey", "o_custkey", "o_totalprice").repartitionByRange(4, "o_orderkey").sortWithinPartitions(
        "o_orderkey")


@entry(book, "src_footer_skip", """
SELECT o_orderkey AS a, o_custkey AS b FROM orders WHERE o_orderkey < (SELECT max(o_orderkey) - 1 FROM orders)""")
def _(t):
    # the last two rows in file order are the footer
    path = _write(_ordered(t), False)
    return d.load(t("region").sparkSession, path, d.Layout(header_rows=0, footer=2, names=("a", "b", "c"), dtypes={
        "a": "bigint", "b": "bigint"})).select("a", "b")


@entry(book, "src_two_digit_year", """
SELECT 'day' AS "column", count(*) AS "rows", true AS keep_text FROM orders UNION ALL SELECT 'customer', 0, false FROM region WHERE r_regionkey = 0""")
def _(t):
    raw = d.load(t("region").sparkSession, _file(t), d.Layout(delimiter=";", na_values=NULLS))
    return d.two_digit_years(raw, ["day", "customer"])


@entry(book, "src_huge_int", """
SELECT 'account' AS "column", count(*) AS beyond_double, true AS exact_integer FROM orders UNION ALL
SELECT 'customer', 0, false FROM region WHERE r_regionkey = 0""")
def _(t):
    df = t("orders").select(F.concat(F.lit("90071992547409"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("account"),
                            F.col("o_custkey").cast("string").alias("customer"))
    return d.huge_integers(df, ["account", "customer"])


@entry(book, "src_huge_int_values", """
SELECT max('90071992547409' || lpad(o_orderkey::VARCHAR, 8, '0')) AS most, count(DISTINCT o_orderkey) AS n FROM orders""")
def _(t):
    df = t("orders").select(d.exact_integer(F.concat(F.lit("90071992547409"), F.lpad(
        F.col("o_orderkey").cast("string"), 8, "0"))).alias("account"))
    return df.agg(F.max("account").cast("string").alias("most"), F.count_distinct("account").alias("n"))


@entry(book, "src_drop_trailing_empty", "SELECT o_orderkey AS a, o_custkey AS b FROM orders")
def _(t):
    df = t("orders").select("o_orderkey", "o_custkey", F.lit(None).cast("string").alias("x"), F.lit(None).cast("string").alias("y"))
    loaded = d.load(t("region").sparkSession, _write(df, False), d.Layout(header_rows=0, names=("a", "b"), dtypes={
        "a": "bigint", "b": "bigint"}))
    return d.drop_trailing_empty(loaded)


def _two_headers(t) -> str:
    """A title line and two header rows before the rows, as a report export has them."""
    rows = t("orders").select(F.col("o_orderkey").cast("string").alias("a"), F.col("o_custkey").cast("string").alias("b"),
                              F.col("o_totalprice").cast("string").alias("c"), F.col("o_orderkey").alias("k"))
    head = rows.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(k).cast("long").alias("k"))
        for a, b, c, k in (("Orders report", None, None, -3), ("Order", None, "Money", -2), ("Number", "Customer", "Total", -1))])))
    return _write(head.unionByName(rows).repartitionByRange(4, "k").sortWithinPartitions("k").drop("k"), False)


@entry(book, "src_header_assemble", "SELECT o_orderkey AS order_number, o_custkey AS order_customer, o_totalprice AS money_total FROM orders",
       "money_total", 2)
def _(t):
    return d.load(t("region").sparkSession, _two_headers(t), d.Layout(
        skip=1, header_rows=2, fill_header=True, dtypes={"order_number": "bigint", "order_customer": "bigint", "money_total": "double"}))


@entry(book, "src_header_guess", """
SELECT 1 AS title_rows, 2 AS header_rows, ',' AS delimiter, 'order_number,order_customer,money_total' AS names, count(*) AS "rows" FROM orders""")
def _(t):
    spark, path = t("region").sparkSession, _two_headers(t)
    guess = d.guess_layout(d.head_lines(spark, path))
    loaded = d.load(spark, path, guess)
    return loaded.agg(F.count("*").alias("rows")).select(
        F.lit(guess.skip).alias("title_rows"), F.lit(guess.header_rows).alias("header_rows"), F.lit(guess.delimiter).alias("delimiter"),
        F.lit(",".join(loaded.columns)).alias("names"), "rows")


@entry(book, "src_pivot_detect", """
SELECT o_custkey AS customer, y AS period, coalesce(sum(o_totalprice) FILTER (WHERE year(o_orderdate)::VARCHAR = y), 0) AS value
FROM orders, (VALUES ('1996'), ('1997'), ('1998')) v(y) GROUP BY 1, 2""", "value", 2)
def _(t):
    wide = t("orders").groupBy(F.col("o_custkey").alias("customer")).agg(*[
        F.coalesce(F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice"))), F.lit(0.0)).alias(str(y))
        for y in (1996, 1997, 1998)])
    return d.unpivot_periods(wide)


@entry(book, "src_describe", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS nulls,
 count(DISTINCT {c}) AS "distinct" FROM customer""" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def _(t):
    return prof_columns(t("customer")).select("column", "rows", (F.col("rows") - F.col("non_null")).alias("nulls"), "distinct")


@entry(book, "src_utc", """SELECT event_id, ts - INTERVAL '5 hours 30 minutes' AS ts FROM events""")
def _(t):
    return d.to_utc(t("events").select("event_id", "ts"), "ts", "Asia/Kolkata")


def _stored(t):
    g = t("lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("quantity"),
                                                                    F.when(F.count("*") % 2 == 0, "N").otherwise("O").alias("flag"))
    path = r.scratch(g.sparkSession, "result")
    first = r.write_result(g, path, [F.desc("quantity"), F.asc("part")])
    return first, g.sparkSession.read.parquet(path)


STORED_SQL = """(SELECT l_partkey AS part, sum(l_quantity) AS quantity, CASE WHEN count(*) % 2 = 0 THEN 'N' ELSE 'O' END AS flag, row_number() OVER (
 ORDER BY sum(l_quantity) DESC, l_partkey) AS row_no FROM lineitem GROUP BY 1)"""


@entry(book, "snk_result", f"SELECT row_no, part, quantity, flag FROM {STORED_SQL} WHERE row_no <= 20", "quantity", 2)
def _(t):
    return _stored(t)[0]


@entry(book, "snk_result_page", f"SELECT row_no, part FROM {STORED_SQL} WHERE row_no BETWEEN 101 AND 140")
def _(t):
    return r.read_page(_stored(t)[1], 101, 140, ["part"])


@entry(book, "snk_inspect", f"""
SELECT row_no, part, quantity, flag FROM {STORED_SQL} WHERE flag = 'N' ORDER BY quantity, flag, part, row_no LIMIT 15 OFFSET 5""", "quantity", 2)
def _(t):
    return r.inspect(_stored(t)[1].select("flag", "part", "quantity", "row_no"), ("flag", "N"), "quantity", limit=15, offset=5)


@entry(book, "snk_run_log", """
SELECT 'trend' AS kind, 'orders' AS dataset, TIMESTAMP '2024-02-02' AS at, 'rows=' || count(*) AS detail FROM orders UNION ALL
SELECT 'profile', 'orders', TIMESTAMP '2024-01-01', 'rows=' || count(*) FROM orders UNION ALL
SELECT 'trend', 'lineitem', TIMESTAMP '2024-01-03', 'rows=' || count(*) FROM lineitem""")
def _(t):
    spark = t("region").sparkSession
    path = r.scratch(spark, "runs")

    def run(kind, dataset, at):
        return t(dataset).agg(F.count("*").alias("n")).select(
            F.expr("uuid()").alias("run_id"), F.lit(kind).alias("kind"), F.lit(dataset).alias("dataset"),
            F.lit(at).cast("timestamp_ntz").alias("at"), F.concat(F.lit("rows="), F.col("n").cast("string")).alias("detail"))

    for kind, dataset, at in (("trend", "orders", dt.datetime(2024, 1, 2)), ("profile", "orders", dt.datetime(2024, 1, 1)),
                              ("trend", "lineitem", dt.datetime(2024, 1, 3)), ("trend", "orders", dt.datetime(2024, 2, 2))):
        r.append_run(spark, path, run(kind, dataset, at))
    return r.latest_runs(spark, path).drop("run_id")
