"""Text values of any length are judged alike, and long ones are not moved."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators import clean, profile

LONG = "x" * 500


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, f"{i}.25" + " " * (i % 3) * 40, ["ab", "AB", LONG, LONG.upper()][i % 4], [" " * 90 + "n/a", "one", "two " * 60][i % 3], None) for i in range(60)]
    return spark.createDataFrame(rows, "k long, price string, name string, note string, none string")


def found(df):
    return sorted(map(tuple, clean.cln_detect(df).drop("id").collect()), key=str)


def test_the_plan_is_the_same_for_every_length_of_short(table, monkeypatch):
    real = clean.histograms
    plans = []
    for short in (0, 3, 64, 10_000):
        monkeypatch.setattr(clean, "histograms", lambda df, columns, n=short: real(df, columns, n))
        plans.append(found(table))
    assert plans[0] == plans[1] == plans[2] == plans[3]
    kinds = {(kind, column): (affected, lost) for kind, column, _, affected, lost in plans[0]}
    assert kinds["case", "name"] == (30, 2)  # both lower-cased forms fold into the upper ones
    assert kinds["convert_type", "price"][0] == 60
    assert kinds["normalise_missing", "note"] == (20, 0)
    assert ("trim", "note") in kinds and not any(column == "none" for _, column in kinds)


def test_impact_of_one_action_equals_the_plan(table):
    plan = {r["id"]: (r["affected"], r["lost"]) for r in clean.cln_detect(table).collect()}
    for a in clean.detect(table):
        r = clean.impact(table, a).first()
        assert (r["affected"], r["lost"]) == plan[a.id]


def test_long_texts_that_differ_at_the_end_are_told_apart(spark):
    rows = [(LONG + "a",), (LONG + "b",), (LONG + "A",)]
    kinds = [(a.kind, a.column) for a in clean.detect(spark.createDataFrame(rows, "v string"))]
    assert ("case", "v") in kinds  # a and A fold into one, b stays
    assert clean.impact(spark.createDataFrame(rows, "v string"), clean.Action("case", "v", {"mode": "upper"})).first()["lost"] == 1


def test_counts_hold_no_long_value(table, monkeypatch):
    staged = []
    real = clean.stage
    monkeypatch.setattr(clean, "stage", lambda df: staged.append(real(df)) or staged[-1])
    clean.histograms(table, ["price", "name", "note"])
    assert staged[0].agg(F.max(F.length("v"))).first()[0] <= clean.SHORT


def test_type_reading_moves_one_row_a_task(table):
    out = profile.prof_type_reading(table)
    assert {r["column"]: (r["considered"], r["best"]) for r in out.collect()} == {"price": (60, "double"), "name": (60, None), "note": (40, None), "none": (0, None)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if re.search(r"Exchange (hash|range)partitioning", line)]
    assert not moves
