"""The plans we mean to get: pruned scans, pushed filters, no raw rows in one partition."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.catalog.base import EVENTS, LINES, ORDERS, events_table, lines_table, table
from plumbline.operators import describe, growth, infer, people, temporal, validate
from plumbline.operators.scope import Scope, scope_counts

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def t(spark):
    return lambda name: table(spark, SF, name)


def columns_read(text: str) -> set[str]:
    return {c.split(":")[0] for m in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in m.split(",") if c}


def test_window_reaches_the_scan(t):
    text = plan(describe.group_totals(Scope.of(t("orders"), ORDERS), ["o_orderpriority"], "revenue"))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate", text)
    assert columns_read(text) == {"o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice"}


def test_scope_counts_is_one_scan(t):
    text = plan(scope_counts(t("orders"), ORDERS))
    assert text.count("FileScan") == 1 and columns_read(text) == {"o_orderdate", "o_orderstatus"}


def test_driver_reads_only_what_it_groups(t):
    s = Scope.of(lines_table(t), LINES)
    text = plan(describe.cross_tab(s, "l_returnflag", "l_linestatus"))
    assert columns_read(text) == {"l_returnflag", "l_linestatus"}


@pytest.mark.parametrize("build", [
    lambda t: temporal.trend(Scope.of(t("orders"), ORDERS), "revenue"),
    lambda t: growth.funnel(Scope.of(events_table(t), EVENTS), "user_id", "event_type", ["view", "click"], 7),
    lambda t: infer.group_moments(Scope.of(lines_table(t), LINES), "l_returnflag", "price"),
    lambda t: people.cohort_retention(Scope.of(t("orders"), ORDERS), "o_custkey"),
    lambda t: validate.val_key_unique(t("orders"), ["o_orderkey"]),
    lambda t: growth.key_overlap(Scope.of(lines_table(t), LINES), "l_partkey", "l_suppkey", "quantity"),
])
def test_raw_rows_never_meet_in_one_partition(t, build):
    """A single-partition exchange may only follow an aggregate, a limit or another shuffle."""
    lines = plan(build(t)).splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = "".join(lines[i + 1:i + 4])
            assert re.search(r"Aggregate|Limit|TakeOrdered|Range|LocalTableScan|Exchange|Project", below), below
            assert "FileScan" not in lines[i + 1]


def test_nothing_is_cross_joined(t):
    for build in (lambda: temporal.trend(Scope.of(t("orders"), ORDERS), "revenue", "month", "o_orderpriority"),
                  lambda: growth.expected_rate_by_bucket(Scope.of(events_table(t), EVENTS), "conversion", "slot", "user_id"),
                  lambda: describe.frequency(Scope.of(t("orders"), ORDERS), "o_orderpriority")):
        text = plan(build())
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_statistics_stay_in_generated_code(t):
    text = plan(infer.group_moments(Scope.of(lines_table(t), LINES), "l_returnflag", "price"))
    assert "HashAggregate" in text and "Python" not in text and "ObjectHashAggregate" not in text
    assert F is not None


def test_wanted_slices_are_broadcast(spark):
    from plumbline.functions import quantiles
    df = spark.range(100_000).selectExpr("id % 3 AS g", "CAST((id * 7919) % 99991 AS double) AS v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = quantiles.selected(df, ["g"], {"m": ("v", 0.5)}, quantiles.probe(df, ["v"]))
        text = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the table is filtered where it is: the slices are the built side
    assert "BroadcastHashJoin" in text and "BuildRight" in text and "SortMergeJoin" not in text
    want = {g: sorted((i * 7919) % 99991 for i in range(g, 100_000, 3)) for g in range(3)}
    for r in out.collect():
        v = want[r["g"]]
        assert r["m"] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
