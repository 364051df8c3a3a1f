"""References are looked up by grouping, without a join of all references and parents."""

import pytest

from plumbline.contract import ForeignKey
from plumbline.operators import validate


@pytest.mark.parametrize("kind", ["long", "int"])
def test_references_with_repeats_nulls_and_parents_of_another_type(spark, kind):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 1), (3, None), (None, 1)], "a long, b long")
    parent = spark.createDataFrame([(1, 1), (1, 1), (3, None), (9, 9)], f"x {kind}, y {kind}")
    got = validate.val_reference(df, parent, ForeignKey(("a", "b"), "p", ("x", "y")))
    r = got.first()
    assert (r["rows"], r["passed"], r["failed"], r["not_checked"]) == (6, 2, 2, 2)
    assert "2" in r["examples"] and "9" not in r["examples"]


def test_keys_of_one_type_are_not_joined(spark):
    df = spark.range(5).selectExpr("id AS a")
    got = validate.val_reference(df, spark.range(3).selectExpr("id AS x"), ForeignKey(("a",), "p", ("x",)))
    plan = got.drop("examples")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and got.first()["failed"] == 2


def test_parents_that_equal_one_reference_after_a_cast_do_not_repeat_it(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    parent = spark.createDataFrame([("1",), ("01",)], "x string")
    r = validate.val_reference(df, parent, ForeignKey(("a",), "p", ("x",))).first()
    assert (r["rows"], r["passed"], r["failed"]) == (2, 1, 1)
