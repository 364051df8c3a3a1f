"""The ways taken beyond a size limit give what the small ways give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline import Contract, Measure, Scope
from plumbline.functions import quantiles, staging
from plumbline.functions.ranks import midranks
from plumbline.operators import describe, relate


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with a third of the rows, NULL groups, NULL values and many ties."""
    rnd = random.Random(7)
    data = []
    for i in range(6000):
        g = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"g{i % 40}"
        x = None if i % 97 == 0 else float(rnd.choice([5, 5, 5, rnd.randint(0, 300), rnd.random() * 1e6]))
        data.append((i, g, x))
    return spark.createDataFrame(data, "id int, g string, x double").repartition(7)


@pytest.mark.parametrize("slices, sort_rows", [(16, 100), (2048, 5_000_000), (4, 0)])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_selected_quantiles_are_exact(skewed, keys, slices, sort_rows):
    want = {"a": ("x", 0.0), "b": ("x", 0.25), "c": ("x", 0.5), "d": ("x", 0.731), "e": ("x", 1.0)}
    small = quantiles.grouped(skewed, keys, [F.count("x").alias("n")], want)
    large = quantiles.grouped(skewed, keys, [F.count("x").alias("n")], want, limit=0, slices=slices, sort_rows=sort_rows)
    a = {r["g"] if keys else 0: r for r in small.collect()}
    b = {r["g"] if keys else 0: r for r in large.collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c in (*want, "n"):
            assert b[k][c] == pytest.approx(a[k][c]), (k, c)


def test_running_totals_across_partitions(skewed, spark):
    order = [F.desc_nulls_last("x"), F.asc("id")]
    big = staging.running(skewed, order, {"up": F.coalesce("x", F.lit(0.0)), "n": F.lit(1)}, small_rows=0)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    one = skewed.select("id", F.sum(F.coalesce("x", F.lit(0.0))).over(w).alias("up"), F.sum(F.lit(1)).over(w).alias("n"))
    a = {r["id"]: (r["up"], r["n"]) for r in one.collect()}
    b = {r["id"]: (r["up"], r["n"]) for r in big.select("id", "up", "n").collect()}
    assert len(a) == len(b) == 6000
    for k in a:
        assert b[k][1] == a[k][1] and b[k][0] == pytest.approx(a[k][0])


def test_midranks_across_partitions(skewed):
    a = {r["x"]: r["midrank"] for r in midranks(skewed, "x").collect()}
    b = {r["x"]: r["midrank"] for r in midranks(skewed, "x", small_rows=0).collect()}
    assert a == b


def test_spearman_across_partitions(skewed):
    s = Scope(skewed.withColumn("y", F.col("x") * F.col("x") + F.col("id")),
              Contract("t", measures=(Measure("x", "none"), Measure("y", "none"))))
    a, b = (relate.correlation(s, "x", "y", small_rows=n).first() for n in (10_000, 0))
    assert a["spearman"] == pytest.approx(b["spearman"], abs=1e-12)
    assert a["pairs"] + a["dropped"] == 6000


def test_ntile_bounds_across_partitions(skewed):
    df = skewed.where("x IS NOT NULL")
    assert relate.ntile_bounds(df, "x", 9) == relate.ntile_bounds(df, "x", 9, small_rows=0)
    n = df.select("x").distinct().withColumn("b", F.ntile(9).over(Window.orderBy("x")))
    tops = sorted(r[0] for r in n.groupBy("b").agg(F.max("x")).select("max(x)").collect())
    assert relate.ntile_bounds(df, "x", 9) == tops


def test_selected_columns_together(skewed):
    df = skewed.withColumns({"y": -F.col("x") * 3 + F.col("id"), "z": F.lit(4.0)})
    want = {"mx": ("x", .5), "qy": ("y", .1), "my": ("y", .5), "mz": ("z", .9)}
    a = {r["g"]: r for r in quantiles.grouped(df, ["g"], [], want).collect()}
    b = {r["g"]: r for r in quantiles.grouped(df, ["g"], [], want, limit=0, slices=32, sort_rows=50).collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c in want:
            assert b[k][c] == pytest.approx(a[k][c]), (k, c)


def test_group_compare_beyond_the_limit(skewed, monkeypatch):
    s = Scope(skewed.withColumn("g", F.when(F.col("g") == "hot", "hot").otherwise("rest")),
              Contract("t", measures=(Measure("x", "median"),), dimensions=("g",)))
    small = {(r["level"], r["member"]): tuple(r) for r in describe.group_compare(s, "g", "x").collect()}
    plain = quantiles.grouped
    monkeypatch.setattr(describe, "grouped", lambda *a, **k: plain(*a, **{**k, "limit": 0}))
    large = {(r["level"], r["member"]): tuple(r) for r in describe.group_compare(s, "g", "x").collect()}
    assert set(small) == set(large) == {("group", "hot"), ("group", "rest"), ("all", None)}
    for k in small:
        assert large[k] == pytest.approx(small[k])


def test_grouped_outliers_count_null_group(skewed):
    few = skewed.withColumn("g", F.when(F.col("g").isNull(), None).when(F.col("g") == "hot", "hot").otherwise("rest"))
    s = Scope(few, Contract("t", measures=(Measure("x", "none"),), dimensions=("g",)))
    got = {r["member"]: r["n"] for r in relate.outlier_within(s, "x", "g").collect()}
    assert set(got) == {None, "hot", "rest"}
    assert sum(got.values()) == skewed.where("x IS NOT NULL").count()


def test_checkpoint_folder_is_the_sessions(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    used = staging.checkpoint_dir(spark)
    if configured:
        assert configured.rstrip("/") in used


def test_distinct_counts_of_all_types(spark, monkeypatch):
    from plumbline.operators import profile
    r = random.Random(2)
    pool = [None, -1, 0, 1, 32_767, 32_768, 32_769, -32_768, 10 ** 9, 2 ** 62, -2 ** 62]
    rows = [(r.choice(pool), r.choice(pool[:8]), r.choice([None, -0.0, 0.0, 1.5, float("nan"), float("inf")]), r.choice([None, "", "a", "A", "é"]),
             r.choice([None, True, False]), i % 7, None) for i in range(900)]
    df = spark.createDataFrame(rows, "l long, d long, f double, s string, b boolean, k long, e int").select(
        "*", F.date_add(F.lit("2024-01-01").cast("date"), F.col("k").cast("int")).alias("day"), F.timestamp_micros(F.coalesce("d", "k")).alias("ts"),
        (F.col("k") / 100 - 0.03).cast("decimal(9,2)").alias("dec"), F.col("k").cast("decimal(30,3)").alias("big"), F.col("k").cast("float").alias("real"))
    want = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first().asDict()
    for rows_a_bitmap in (512, 1, 10 ** 9):
        monkeypatch.setattr(profile, "ROWS_A_BITMAP", rows_a_bitmap)
        assert profile.distinct_counts(df) == want
    assert profile.distinct_counts(df.where("false")) == dict.fromkeys(df.columns, 0)


def test_profiling_takes_two_shuffles(spark, monkeypatch):
    """Bitmaps of all columns move in one exchange, values of all others in another; besides these, only one row per column does."""
    from plumbline.operators import profile
    seen, facts = [], profile._facts
    monkeypatch.setattr(profile, "reduce", lambda f, parts: seen.append(len(parts)) or __import__("functools").reduce(f, parts))
    rows, held = facts(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), ["l_orderkey", "l_partkey", "l_tax", "l_returnflag", "l_shipdate"])
    assert seen == [2, 3] and rows > 0 and held["l_returnflag"]["distinct"] == 3
