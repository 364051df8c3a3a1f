import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline import Contract, Measure, Scope
from plumbline.errors import Refused
from plumbline.functions.aggs import declared
from plumbline.operators import templates as m

DAY = dt.date(2024, 1, 1)


def test_weighted_mean_leaves_out_what_has_no_value_or_weight(spark):
    c = Contract(name="t", measures=(Measure("x", "weighted_mean", column="v", weight="w"),))
    rows = [("a", 1.0, 1.0), ("a", 3.0, 3.0), ("a", None, 100.0), ("a", 100.0, None), ("a", 100.0, 0.0), ("b", 5.0, 0.0), ("c", None, 1.0),
            ("d", 1.0, float("nan"))]
    df = Scope.of(spark.createDataFrame(rows, "g string, v double, w double"), c).df
    got = {r["g"]: r["x"] for r in df.groupBy("g").agg(declared(c.measure("x")).alias("x")).collect()}
    assert got == {"a": 2.5, "b": None, "c": None, "d": None}
    with pytest.raises(Refused):
        Measure("x", "weighted_mean", column="v")


def events(seed, units=7, n=80):
    r = random.Random(seed)
    return [(r.choice([*range(units), None]), r.choice("pq"), DAY + dt.timedelta(days=r.choice([0, 3, 40, 41, 95, 200, 400])),
             r.choice([None, 1.0, 2.5, -4.0, 10.0])) for _ in range(n)]


CONTRACT = Contract(name="t", date_column="day_", measures=(Measure("stock", "level", column="v", per=("u",)),))


@pytest.mark.parametrize("by", [(), ("g",)])
def test_levels_carry_over_missing_periods(spark, by):
    rows = events(3)
    scope = Scope.of(spark.createDataFrame(rows, "u int, g string, day_ date, v double"), CONTRACT)
    changes = m.stage(m.level_changes(scope, "stock", by))
    got = {(r["period"], *[r[c] for c in by]): (r["level"], r["units"]) for r in m.levels(changes, "month", by).collect()}
    want = {}
    for k in range(14):
        start = dt.date(2024 + k // 12, k % 12 + 1, 1)
        end = dt.date(2024 + (k + 1) // 12, (k + 1) % 12 + 1, 1)
        last = {}
        for u, g, day, v in rows:
            if u is not None and v is not None and day < end:
                key = (u, *((g,) if by else ()))
                last[key] = max(last.get(key, (dt.date.min, 0.0)), (day, v))
        for member in {k[1:] for k in last}:
            values = [v for k, (_, v) in last.items() if k[1:] == member]
            want[(start, *member)] = (sum(values), len(values))
    assert {k: v for k, v in got.items() if k[0] <= dt.date(2025, 2, 1)} == want


def test_changes_add_up_over_parts_of_the_units(spark):
    df = spark.createDataFrame(events(5), "u int, g string, day_ date, v double")
    whole = m.level_changes(Scope.of(df, CONTRACT), "stock")
    halves = [m.level_changes(Scope.of(df.where(F.col("u") % 2 == k), CONTRACT), "stock") for k in (0, 1)]
    added = halves[0].unionByName(halves[1]).groupBy("day").agg(F.sum("change").alias("change"), F.sum("started").alias("started"))
    assert sorted(map(tuple, added.collect())) == sorted(map(tuple, whole.select("day", "change", "started").collect()))


def test_a_level_has_no_total(spark):
    with pytest.raises(Refused, match="level"):
        declared(CONTRACT.measure("stock"))
    with pytest.raises(Refused):
        Measure("x", "level")
    empty = Scope.of(spark.createDataFrame([], "u int, g string, day_ date, v double"), CONTRACT)
    assert m.levels(m.level_changes(empty, "stock"), "month").count() == 0


def test_distinct_states_merge_exactly(spark):
    r = random.Random(7)
    rows = [(DAY + dt.timedelta(days=r.randrange(90)), r.choice([None, r.randrange(-70_000, 200_000), r.randrange(20)]), r.choice("pq")) for _ in range(4000)]
    df = spark.createDataFrame(rows, "d date, n long, g string")
    state = m.stage(m.distinct_state(df, "d", "n", ("g",)))
    assert m.distinct_over(state).first()["distinct"] == len({n for _, n, _ in rows if n is not None})
    got = {(x["period"], x["g"]): x["distinct"] for x in m.distinct_over(state, F.trunc("day", "month"), ("g",)).collect()}
    want = {}
    for d, n, g in rows:
        if n is not None:
            want.setdefault((d.replace(day=1), g), set()).add(n)
    assert got == {k: len(v) for k, v in want.items()}
    # two halves of the rows, each with its state
    parts = m.distinct_state(df.where("n % 3 = 0"), "d", "n").unionByName(m.distinct_state(df.where("n % 3 <> 0"), "d", "n"))
    assert m.distinct_over(parts).first()["distinct"] == len({n for _, n, _ in rows if n is not None})
    assert m.distinct_over(m.distinct_state(df.where("false"), "d", "n")).first()["distinct"] == 0


def test_the_state_is_all_that_is_read(spark):
    """Periods are counted from stored states: no plan goes back to the rows."""
    df = spark.createDataFrame([(DAY, 1), (DAY, 2)], "d date, n long")
    state = m.stage(m.distinct_state(df, "d", "n"))
    plan = m.distinct_over(state, F.trunc("day", "year"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "construct" not in plan


def test_dictionary_is_dense(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "v string")
    assert sorted(map(tuple, m.numbered(df, "v").select("value", "id").collect())) == [("a", 1), ("b", 2), ("c", 3)]
