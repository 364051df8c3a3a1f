"""Groups that hold the same amounts tie, in whatever order their rows are added."""

from plumbline import Contract, Measure
from plumbline.functions.aggs import steady_sum
from plumbline.operators import describe
from plumbline.operators.scope import Scope
from pyspark.sql import functions as F


def test_groups_of_equal_amounts_are_in_order_of_their_names(spark):
    # 0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1 when doubles are added one by one
    rows = [("a", 0.3), ("a", 0.2), ("a", 0.1), ("b", 0.1), ("b", 0.2), ("b", 0.3), ("c", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double").coalesce(1)
    scope = Scope.of(df, Contract("t", measures=(Measure("v", "sum"),), dimensions=("k",)))
    assert [r["member"] for r in describe.pareto(scope, "k", "v").orderBy("rank").collect()] == ["c", "a", "b"]
    assert [r["member"] for r in describe.top_n(scope, "k", "v").orderBy("rank").collect()] == ["c", "a", "b"]


def test_steady_sums_keep_small_large_and_absent_values(spark):
    df = spark.createDataFrame([("small", 1e-12), ("small", 2e-12), ("large", 1e300), ("large", 1.5), ("none", None),
                                ("odd", float("nan")), ("odd", 1.0)], "k string, v double")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(steady_sum(F.col("v")).alias("s")).collect()}
    assert abs(got["small"] - 3e-12) < 1e-24 and got["large"] == 1e300 and got["none"] is None and got["odd"] != got["odd"]
