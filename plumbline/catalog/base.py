"""Helpers shared by the catalogue: tables, contracts, rounding, and the pairing with SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import Contract, Exclusion, Measure, Window
from ..operators.scope import Scope

DIGITS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def nudge(digits: int) -> float:
    """Moves values off exact halves, where the last bit of a sum would decide how they round."""
    return 0.37 * 10.0 ** -(digits + 2)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles at a fixed precision, so that summation order cannot show in a comparison."""
    return df.withColumns({f.name: F.round(F.col(f"`{f.name}`") + F.lit(nudge(digits)), digits)
                           for f in df.schema.fields
                           if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def entry(book: dict, name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    """Register a query with its SQL; ``doubles`` names the columns both sides round."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(lambda t: table(spark, sf_dir, t)), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        text = sql
        if sql and doubles:
            reps = ", ".join(f"round(CAST({c} AS DOUBLE) + {nudge(digits)!r}, {digits}) + 0.0 AS {c}"
                             for c in doubles.split())
            text = f"SELECT * REPLACE ({reps}) FROM ({sql}) AS q"
        if name in book:
            raise KeyError(name)
        book[name] = (run, text)
        return fn

    return wrap


ORDERS = Contract(
    name="orders", key=("o_orderkey",), date_column="o_orderdate",
    window=Window("1996-01-01", "1999-12-31"),
    exclusions=(Exclusion("o_orderstatus = 'P'", "pending"),),
    measures=(Measure("revenue", "sum", column="o_totalprice"),
              Measure("avg_price", "mean", column="o_totalprice"),
              Measure("mid_price", "median", column="o_totalprice"),
              Measure("low_price", "min", column="o_totalprice"),
              Measure("high_price", "max", column="o_totalprice"),
              Measure("orders", "count", column="o_orderkey"),
              Measure("customers", "count_distinct", column="o_custkey"),
              Measure("o_orderkey", "none")),
    dimensions=("o_orderpriority", "o_orderstatus", "o_custkey"))

#: The rows ORDERS keeps, as SQL.
ORDERS_SQL = ("(SELECT * FROM orders WHERE NOT coalesce(o_orderstatus = 'P', false) AND "
              "o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1999-12-31' + INTERVAL 1 DAY)")

LINES = Contract(
    name="lineitem", key=("l_orderkey", "l_linenumber"), date_column="l_shipdate",
    measures=(Measure("quantity", "sum", column="l_quantity"),
              Measure("price", "sum", column="l_extendedprice"),
              Measure("avg_price", "mean", column="l_extendedprice"),
              Measure("discount", "mean", column="l_discount"),
              Measure("rows_counted", "count", column="l_orderkey"),
              Measure("disc_units", "sum", column="disc_units"),
              Measure("discount_rate", "ratio", numerator=("disc_value",),
                      denominator=("l_extendedprice",)),
              Measure("bulk", "mean", compare=("l_quantity", ">", 25))),
    dimensions=("l_returnflag", "l_linestatus", "l_suppkey", "l_partkey", "l_linenumber",
                "l_orderkey"))


def lines_table(t) -> DataFrame:
    return t("lineitem").withColumns({
        "disc_value": F.col("l_extendedprice") * F.col("l_discount"),
        "disc_units": F.col("l_quantity") * F.col("l_discount")})


LINES_SQL = ("(SELECT *, l_extendedprice * l_discount AS disc_value, l_quantity * l_discount AS "
             "disc_units FROM lineitem)")

EVENTS = Contract(
    name="events", key=("event_id",), date_column="ts",
    measures=(Measure("value", "sum"), Measure("avg_value", "mean", column="value"),
              Measure("events", "count", column="event_id"),
              Measure("purchases", "sum", column="is_purchase"),
              Measure("clicks", "sum", column="is_click"),
              Measure("conversion", "ratio", numerator=("is_purchase",), denominator=("one",)),
              Measure("value_rate", "ratio", numerator=("value",), denominator=("one",))),
    dimensions=("event_type", "user_id", "variant", "hour"))


def events_table(t) -> DataFrame:
    kind = F.col("event_type")
    return t("events").withColumns({
        "is_purchase": (kind == "purchase").cast("int"), "is_click": (kind == "click").cast("int"),
        "one": F.lit(1), "variant": F.pmod("event_id", F.lit(2)).cast("int"),
        "hour": F.hour("ts"), "slot": (F.pmod("event_id", F.lit(24)) + 1).cast("int")})


EVENTS_SQL = ("(SELECT *, CAST(event_type = 'purchase' AS INT) AS is_purchase, "
              "CAST(event_type = 'click' AS INT) AS is_click, 1 AS one, "
              "CAST(event_id % 2 AS INT) AS variant, CAST(hour(ts) AS INT) AS hour, "
              "CAST(event_id % 24 + 1 AS INT) AS slot FROM events)")


def orders(t, contract: Contract = ORDERS) -> Scope:
    return Scope.of(t("orders"), contract)


def lines(t) -> Scope:
    return Scope.of(lines_table(t), LINES)


def events(t) -> Scope:
    return Scope.of(events_table(t), EVENTS)
