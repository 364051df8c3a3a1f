"""Contract checks (section 2.14)."""

from pyspark.sql import functions as F

from ..contract import Contract, Expectation, ForeignKey, Window
from ..operators import validate as v
from .base import entry
from .planted import FAULTY_SQL, TODAY, faulty

book: dict = {}

ROW = """SELECT '{check}' AS "check", '{subject}' AS subject, n AS "rows", n - f - s AS passed, f AS failed, s AS not_checked,
 coalesce((SELECT string_agg(x, ' | ' ORDER BY x) FROM ({shown})), '') AS examples FROM (SELECT {counts} FROM {f})"""


def sql(check, subject, counts, shown="SELECT NULL AS x WHERE false", f=FAULTY_SQL):
    return ROW.format(check=check, subject=subject, counts=counts, shown=shown, f=f)


def _counts(failed, skipped="0"):
    return (f"count(*) AS n, count(*) FILTER (WHERE {failed}) AS f, " +
            (f"count(*) FILTER (WHERE {skipped}) AS s" if skipped != "0" else "0::BIGINT AS s"))


REPEATED = f"(SELECT order_id FROM {FAULTY_SQL} WHERE order_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"

SQL = {
    "val_key_unique": sql("key.unique", "order_id", _counts(f"order_id IN {REPEATED}", "order_id IS NULL"),
                          f"SELECT 'order_id=' || order_id AS x FROM {REPEATED} ORDER BY order_id LIMIT 10"),
    "val_key_complete": sql("key.complete", "order_id", _counts("order_id IS NULL")),
    "val_date_present": sql("date.present", "order_date", _counts("order_date IS NULL")),
    "val_date_in_window": sql("date.in_window", "order_date", _counts(
        "order_date < DATE '1996-01-01' OR order_date > DATE '1999-12-31'", "order_date IS NULL")),
    "val_date_not_future": sql("date.not_future", "order_date",
                               _counts(f"order_date > DATE '{TODAY}'", "order_date IS NULL")),
    "val_reference": sql("reference", "customer_id -> customer", _counts(
        "customer_id IS NOT NULL AND customer_id NOT IN (SELECT c_custkey FROM customer)", "customer_id IS NULL"),
        f"SELECT DISTINCT 'customer_id=' || customer_id AS x FROM {FAULTY_SQL} WHERE customer_id NOT IN "
        "(SELECT c_custkey FROM customer)"),
    "val_domain": sql("domain", "status", _counts("status NOT IN ('F', 'O', 'P')", "status IS NULL"),
                      f"SELECT DISTINCT 'status=' || status AS x FROM {FAULTY_SQL} WHERE status NOT IN ('F', 'O', 'P')"),
    "val_expectation": sql("expectation", "price > 0", _counts("NOT (price > 0)", "price IS NULL"),
                           f"SELECT 'order_id=' || coalesce(order_id::VARCHAR, 'NULL') AS x FROM {FAULTY_SQL} "
                           "WHERE NOT (price > 0) ORDER BY order_id NULLS LAST LIMIT 10"),
    "val_row_count": """SELECT 'table.row_count' AS "check", '100' AS subject, count(*) AS "rows", count(*) AS passed,
 0::BIGINT AS failed, 0::BIGINT AS not_checked, '' AS examples FROM """ + FAULTY_SQL,
}

FK = ForeignKey(("customer_id",), "customer", ("c_custkey",))
CONTRACT = Contract("faulty", key=("order_id",), date_column="order_date", window=Window("1996-01-01", "1999-12-31"),
                    foreign_keys=(FK,), domains={"status": ("F", "O", "P")},
                    expectations=(Expectation("price > 0"),), row_count=100)

RUNS = {
    "val_key_unique": lambda t: v.val_key_unique(faulty(t), ["order_id"]),
    "val_key_complete": lambda t: v.val_key_complete(faulty(t), ["order_id"]),
    "val_date_present": lambda t: v.val_date_present(faulty(t), "order_date"),
    "val_date_in_window": lambda t: v.val_date_in_window(faulty(t), "order_date", "1996-01-01", "1999-12-31"),
    "val_date_not_future": lambda t: v.val_date_not_future(faulty(t), "order_date", TODAY),
    "val_reference": lambda t: v.val_reference(faulty(t), t("customer"), FK),
    "val_domain": lambda t: v.val_domain(faulty(t), "status", ["F", "O", "P"]),
    "val_expectation": lambda t: v.val_expectation(faulty(t), "price > 0", ["order_id"]),
    "val_row_count": lambda t: v.val_row_count(faulty(t), 100),
}

for _name, _fn in RUNS.items():
    entry(book, _name, SQL[_name])(_fn)


@entry(book, "val_report", " UNION ALL ".join(f"SELECT * FROM ({s})" for s in SQL.values()))
def _(t):
    return v.val_report(faulty(t), CONTRACT, TODAY, {"customer": t("customer")})


@entry(book, "val_reference_composite", sql(
    "reference", "l_partkey + l_suppkey -> part_supplier", _counts(
        "(l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 25)"), f="lineitem"))
def _(t):
    known = F.col("l_quantity") > 25
    parent = t("lineitem").select(*[F.when(known, F.col(c)).alias(c) for c in ("l_partkey", "l_suppkey")])
    fk = ForeignKey(("l_partkey", "l_suppkey"), "part_supplier", ("l_partkey", "l_suppkey"))
    return v.val_reference(t("lineitem"), parent, fk).withColumn("examples", F.lit(""))
