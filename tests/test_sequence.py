import random

from pyspark.sql import functions as F

from plumbline.functions.sequence import with_neighbours
from plumbline.functions.staging import _range_staged


def by_hand(rows):
    """{id: (next id, previous id, first)} of (entity, at, id) rows, nulls first."""
    key = lambda r: ((r[0] is not None, r[0] or ""), (r[1] is not None, r[1] or 0), r[2])
    ranked, out = sorted(rows, key=key), {}
    for i, r in enumerate(ranked):
        after = ranked[i + 1] if i + 1 < len(ranked) and ranked[i + 1][0] == r[0] else None
        before = ranked[i - 1] if i and ranked[i - 1][0] == r[0] else None
        out[r[2]] = (after and after[2], before and before[2], before is None)
    return out


def got(df):
    return {r["id"]: (r["n"], r["p"], r["f"]) for r in with_neighbours(df, ["who"], ["at", "id"], {"n": "id"}, {"p": "id"}, "f").collect()}


SCHEMA = "who string, at int, id long, extra string"


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(3)
    # a third of the rows belong to one entity, some to none, times tie and are missing
    rows = [(rng.choice(["hot", None, *"abcdefgh", *"abcdefgh"]) if i % 3 else "hot", rng.choice([None, *range(40)]), i, "x") for i in range(3000)]
    for parts in (1, 3, 8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == by_hand(rows)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_few_rows_and_none(spark):
    for rows in ([], [("a", 1, 1, None)], [("a", 1, 1, None), ("b", 1, 2, None)], [(None, None, 1, None), (None, None, 2, None)]):
        assert got(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)


def test_a_hot_entity_is_spread_evenly(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(80_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("who"), F.col("id").alias("at"))
        sizes = [r["count"] for r in _range_staged(df, [F.col("who"), F.col("at")]).groupBy("__part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 2 * 80_000 / 8
