"""Literal tables with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline import Contract, Measure, Refused, Scope, Window
from plumbline.functions import dist
from plumbline.operators import describe, growth, infer, people, relate, temporal


def scope(df, **kw):
    return Scope.of(df, Contract("t", **kw))


def test_distribution_functions():
    assert dist.t_sf(2.228138852, 10) == pytest.approx(0.025, abs=1e-9)
    assert dist.t_isf(0.025, 10) == pytest.approx(2.2281388519649385, abs=1e-9)
    assert dist.f_sf(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert dist.norm_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-12)
    assert dist.rows_for_effect(0.5) == pytest.approx(63.765610588911635, abs=1e-5)
    assert dist.two_sample_power(0.5, 64, 64) == pytest.approx(0.8014596, abs=1e-6)


def test_hedges_correction():
    a = {"n": 10, "mean": 1.0, "variance": 1.0}
    b = {"n": 10, "mean": 0.0, "variance": 1.0}
    assert infer.hedges_g(a, b) == pytest.approx(0.957746, abs=1e-6)


def test_chi_square_two_by_two_is_corrected(spark):
    c = infer.chi_square(spark.createDataFrame([("a", "x", 30), ("a", "y", 20), ("b", "x", 15), ("b", "y", 35)], "a string, b string, n long"))
    gap = abs(30 * 35 - 20 * 15) - 50
    assert c["statistic"] == pytest.approx(100 * gap ** 2 / (50 * 50 * 45 * 55))
    assert c["plain"] == pytest.approx(100 * (30 * 35 - 20 * 15) ** 2 / (50 * 50 * 45 * 55))


def test_mix_shift_known_split(spark):
    # group means 100 -> 110 and 10 -> 12 while the mix moves to the cheap group: 82.0 -> 31.6
    data = ([("2024-01-05", "a", 100.0)] * 8 + [("2024-01-05", "b", 10.0)] * 2
            + [("2024-02-05", "a", 110.0)] * 2 + [("2024-02-05", "b", 12.0)] * 8)
    df = spark.createDataFrame(data, "d string, g string, x double").withColumn("d", F.to_date("d"))
    s = scope(df, date_column="d", measures=(Measure("x", "mean"),), dimensions=("g",))
    t = temporal.mix_shift(s, "x", "g", "2024-02", "2024-01").agg(
        *[F.sum(c).alias(c) for c in ("rate", "mix", "interaction", "contribution")]).first()
    assert t["rate"] == pytest.approx(8.4)
    assert t["mix"] == pytest.approx(-54.0)
    assert t["interaction"] == pytest.approx(-4.8)
    assert t["contribution"] == pytest.approx(31.6 - 82.0)


def test_pearson_misses_a_u(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("x"),
                                   F.pow(F.col("id") - 5.5, F.lit(2)).alias("y"))
    s = scope(df, measures=(Measure("x", "none"), Measure("y", "none")))
    assert relate.correlation(s, "x", "y").first()["pearson"] == pytest.approx(0.0, abs=1e-12)
    means = [r["mean_y"] for r in relate.bivariate(s, "x", "y", 5).orderBy("bin").collect()]
    assert means[0] > means[2] < means[4]


def test_bivariate_keeps_ties_together(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 6 + [(2.0, 5.0), (3.0, 7.0)], "x double, y double")
    s = scope(df, measures=(Measure("x", "none"), Measure("y", "none")))
    got = relate.bivariate(s, "x", "y", 2).orderBy("bin").collect()
    assert [(r["x_from"], r["x_to"], r["rows"]) for r in got] == [(1.0, 2.0, 7), (3.0, 3.0, 1)]


def test_z_score_is_masked(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 11), 1000, 1010]] + [(None,)], "x double")
    s = scope(df, measures=(Measure("x", "none"),))
    got = {r["method"]: r["flagged"] for r in relate.outlier_detection(s, "x").collect()}
    assert got["tukey"] == 2 and got["mad"] == 2 and got["z"] < 2


def test_dead_methods_have_no_bounds(spark):
    df = spark.createDataFrame([(5.0,)] * 12 + [(9.0,)], "x double")
    s = scope(df, measures=(Measure("x", "none"),))
    got = {r["method"]: r for r in relate.outlier_detection(s, "x").collect()}
    assert got["mad"]["lower"] is None and got["mad"]["flagged"] is None
    with pytest.raises(Refused):
        relate.outlier_detection(Scope(s.df.limit(5), s.contract), "x")


def meter(spark, values, missing=()):
    data = [(f"2024-{m + 1:02d}-01", float(v)) for m, v in enumerate(values) if m not in missing]
    return spark.createDataFrame(data, "d string, x double").withColumn("d", F.to_date("d"))


def test_clean_step_is_found(spark):
    s = scope(meter(spark, [10] * 6 + [50] * 6), date_column="d", measures=(Measure("x", "mean"),))
    got = relate.changepoint(s, "x").orderBy(F.desc(F.abs("difference"))).collect()
    assert str(got[0]["split_after"]) == "2024-06-01" and got[0]["difference"] == pytest.approx(40.0)
    assert got[0]["separation"] is None
    assert got[1]["difference"] == pytest.approx(34.2857, abs=1e-3)


def test_splits_beside_a_gap_are_left_out(spark):
    s = scope(meter(spark, [10] * 6 + [50] * 6, missing=(5,)), date_column="d",
              window=Window("2024-01-01", "2024-12-31"), measures=(Measure("x", "mean"),))
    got = {str(r[0]) for r in relate.changepoint(s, "x").select("split_after").collect()}
    assert "2024-05-01" not in got and "2024-06-01" not in got and "2024-07-01" in got


def test_cross_tab_margins_keep_null_members(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "x"), (None, None), ("b", "x")],
                               "r string, c string")
    got = describe.cross_tab(scope(df, dimensions=("r", "c")), "r", "c").collect()
    cells = sum(r["value"] for r in got if r["kind"] == "cell")
    margins = sum(r["value"] for r in got if r["kind"] == "row_total")
    assert cells == margins == next(r["value"] for r in got if r["kind"] == "total") == 5


def test_growth_parts_add_to_the_change(spark):
    df = spark.createDataFrame([("2024-01-01", "a", 5.0), ("2024-01-01", None, 7.0), ("2024-02-01", "a", 9.0),
                                ("2024-02-01", "c", 1.0)], "d string, g string, x double").withColumn(
        "d", F.to_date("d"))
    s = scope(df, date_column="d", measures=(Measure("x", "sum"),), dimensions=("g",))
    got = temporal.growth_decomposition(s, "x", "g", "2024-02", "2024-01").collect()
    assert sum(r["change"] for r in got) == pytest.approx(10.0 - 12.0)
    by = {r["member"]: r for r in got}
    assert by["c"]["entrant"] and by["c"]["baseline_value"] is None
    assert by[None]["leaver"] and by[None]["period_value"] is None


def test_funnel_order_and_window(spark):
    data = [("u1", "2024-01-01", "a"), ("u1", "2024-01-02", "b"), ("u1", "2024-01-03", "c"),
            ("u2", "2024-01-01", "a"), ("u2", "2024-01-02", "c"),          # skips b
            ("u3", "2024-01-05", "a"), ("u3", "2024-01-01", "b"),          # wrong order
            ("u4", "2024-01-01", "a"), ("u4", "2024-01-20", "b")]          # too late
    df = spark.createDataFrame(data, "u string, d string, e string").withColumn("d", F.to_date("d"))
    s = scope(df, date_column="d", dimensions=("e", "u"))
    got = [r["entities"] for r in growth.funnel(s, "u", "e", ["a", "b", "c"], 7).orderBy("position").collect()]
    assert got == [4, 1, 1]
    free = [r["entities"] for r in growth.funnel(s, "u", "e", ["a", "b", "c"]).orderBy("position").collect()]
    assert free == [4, 2, 1]


def test_confidence_interval_uses_t(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5)] + [("b", 1.0)], "g string, x double")
    s = scope(df, measures=(Measure("x", "mean"),), dimensions=("g",))
    got = {r["member"]: r for r in infer.confidence_interval(s, "g", "x").collect()}
    half = 2.7764451051977987 * math.sqrt(2.5 / 5)
    assert got["a"]["low"] == pytest.approx(3 - half) and got["a"]["high"] == pytest.approx(3 + half)
    assert got["b"]["low"] is None and got["b"]["mean"] == 1.0


def test_p_values(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5)]
                               + [("b", float(v)) for v in (3, 4, 5, 6, 9)], "g string, x double")
    s = scope(df, measures=(Measure("x", "mean"),), dimensions=("g",))
    r = infer.hypothesis_test(s, "g", "x").first()
    assert r["test"] == "welch" and r["statistic"] == pytest.approx(-2.4 / math.sqrt(1.56), abs=1e-9)
    assert r["p"] == pytest.approx(2 * dist.t_sf(2.4 / math.sqrt(1.56), 1.56 ** 2 / (0.25 / 4 + 1.06 ** 2 / 4)), abs=1e-9)
    one = Scope(df.where("g = 'a' OR x = 9"), s.contract)
    assert infer.hypothesis_test(one, "g", "x").first()["test"] == "mann_whitney"


def test_ab_test_says_when_it_cannot(spark):
    df = spark.createDataFrame([("a", 10, 50), ("b", 12, 60)], "v string, ok int, n int")
    m = (Measure("rate", "ratio", numerator=("ok",), denominator=("n",)),)
    s = scope(df, measures=m, dimensions=("v",))
    assert growth.ab_test(s, "v", "rate").first()["verdict"] == "not_enough_data"
    df2 = spark.createDataFrame([("a", 10, 1000), ("b", 12, 2000)], "v string, ok int, n int")
    assert growth.ab_test(scope(df2, measures=m, dimensions=("v",)), "v", "rate").first()[
        "verdict"] == "sample_ratio_mismatch"


def test_repeat_refuses_events(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "k int, d string").withColumn(
        "d", F.to_date("d"))
    with pytest.raises(Refused):
        people.repeat_behaviour(scope(df, date_column="d"), "k")


def test_shares_are_refused_for_signed_totals(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", -1.0)], "g string, x double")
    s = scope(df, measures=(Measure("x", "sum"),), dimensions=("g",))
    assert all(r["share"] is None for r in describe.top_n(s, "g", "x").collect())
    with pytest.raises(Refused):
        describe.pareto(s, "g", "x")


@pytest.mark.parametrize("rule", ["x >", "1; drop table t", "(select 1)", "x + 1", "nope = 1"])
def test_bad_rules(spark, rule):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(Refused):
        Scope(df, Contract("t")).where(rule)


def test_per_unit_refuses_varying_columns(spark):
    df = spark.createDataFrame([(1, 10.0, "a"), (1, 10.0, "b"), (2, 7.0, "a")], "o int, fee double, p string")
    m = (Measure("fee", "sum", per=("o",)),)
    s = scope(df, measures=m, dimensions=("p",))
    assert s.units(["fee"]).df.agg(F.sum("fee")).first()[0] == 17.0
    with pytest.raises(Refused):
        describe.group_compare(s, "p", "fee")


def test_window_keeps_the_last_second(spark):
    df = spark.createDataFrame([("2024-12-31 23:59:59",), ("2025-01-01 00:00:00",), (None,)], "d string").withColumn(
        "d", F.col("d").cast("timestamp_ntz"))
    c = Contract("t", date_column="d", window=Window("2024-01-01", "2024-12-31"))
    assert Scope.of(df, c).df.count() == 1


def test_claims_with_words_between_and_other_units(spark):
    from plumbline.operators.keys import caveat_check
    df = spark.createDataFrame([(1, -1, "x")] * 3 + [(2, 5, "y"), (3, 6, "z")], "k int, a int, t string")
    got = {r["claim"]: (r["status"], r["measured"]) for r in caveat_check(df, [
        "2 exact duplicate rows", "3 lines where a < 0", "3 of the entries where a < 0", "4 entries where a > 9", "2 rows where t < 4"]).collect()}
    assert got["2 exact duplicate rows"] == ("agrees", 2)
    assert got["3 lines where a < 0"] == ("agrees", 3) == got["3 of the entries where a < 0"]
    assert got["4 entries where a > 9"] == ("differs", 0)
    assert got["2 rows where t < 4"] == ("unchecked", None)  # text and a number don't compare


def test_names_are_read_joined_too():
    from plumbline.functions.words import joined_words
    assert "onhand" in joined_words("stockOnHand") and "onhand" in joined_words("qty_on_hand")


def test_ratio_search_does_not_depend_on_the_order_of_rows(spark):
    from plumbline.operators.suggest import ratio_search
    rows = [(i / 7.0 if i % 60 else -1.0, float(i), 7.0, 3.0 + i % 5) for i in range(1, 601)]
    schema = "r double, a double, b double, c double"
    wrong_first = sorted(rows, key=lambda r: r[0] != -1.0)
    for some in (rows, wrong_first, rows[::-1]):
        found = ratio_search(spark.createDataFrame(some, schema), "r", ["a", "b", "c"])
        assert found and found[0] == "a / b"


def test_formulae_are_counted_as_spark_reads_them(spark):
    """Missing values, zeros, NaN and infinities, against the same formulae as columns."""
    from pyspark.sql import functions as F
    from plumbline.operators.suggest import FORMS, counted
    import random
    r = random.Random(3)
    pool = [None, 0.0, -0.0, 1.0, 2.0, 0.5, 50.0, 1e-320, 1e300, float("nan"), float("inf"), -3.0]
    df = spark.createDataFrame([tuple(r.choice(pool) for _ in range(3)) for _ in range(3000)], "x double, a double, b double")
    tries = [("x", p, q, k) for p, q in (("a", "b"), ("b", "a")) for k in range(len(FORMS))]
    got = counted(df, tries)
    rows = df.where("x IS NOT NULL AND x <> 0")
    for m, p, q, k in tries:
        a, b, scale = F.col(p), F.col(q), FORMS[k][3]
        y = F.try_divide(F.lit(scale) * ((a - b) if k in (2, 3) else a), a if k in (2, 3) else b)
        tol = 0.00006 if scale == 1.0 else 0.006
        gap = F.abs(F.col("x") - y)
        fits = ~F.isnan(gap) & (gap <= F.lit(tol) + F.lit(1e-4) * F.abs(y))
        want = rows.agg(F.count(y), F.count_if(F.coalesce(fits, F.lit(False)))).first()
        assert got[m, p, q, k] == tuple(want), (p, q, k)
    assert counted(df.where("false"), tries) == dict.fromkeys(tries, (0, 0))


def test_more_groups_than_a_page_holds(spark):
    from plumbline import Contract, Measure, Scope
    from plumbline.operators import describe, infer, temporal
    from plumbline.contract import Window
    df = spark.range(3000).selectExpr("id", "id % 75 AS g", "id % 60 AS h", "CAST((id * 7919) % 1000 AS double) AS v", "date_add(DATE'2024-01-01', CAST(id % 90 AS int)) AS d")
    scope = Scope.of(df, Contract(name="t", key=("id",), date_column="d", window=Window("2024-01-01", "2024-12-31"),
                                  measures=(Measure("v", "sum"),), dimensions=("g", "h")))
    assert describe.group_compare(scope, "g", "v").count() == 76
    assert describe.cross_tab(scope, "g", "h").where("kind = 'row_total'").count() == 75
    assert temporal.trend(scope, "v", "month", "g").select("member").distinct().count() == 76
    assert infer.hypothesis_test(scope, "g", "v", method="rank").first()["df1"] == 74
    c = infer.hypothesis_test(scope, "g", second_dimension="h").first()
    from collections import Counter
    cells = Counter((i % 75, i % 60) for i in range(3000))
    expected = sum((cells[a, b] - 40 * 50 / 3000) ** 2 / (40 * 50 / 3000) for a in range(75) for b in range(60))
    assert abs(c["statistic"] - expected) < 1e-6


def test_a_negative_total_has_no_shares(spark):
    from plumbline import Contract, Measure, Scope
    from plumbline.operators.growth import key_overlap
    df = spark.createDataFrame([("k", f"m{i}", 1.0) for i in range(50)] + [("k", "back", -100.0), ("n", "a", 3.0), ("n", "b", 4.0)], "k string, m string, v double")
    got = key_overlap(Scope.of(df, Contract(name="t", key=("k",), measures=(Measure("v", "sum"),), dimensions=("k", "m"))), "k", "m", "v").collect()
    assert [(r["key"], r["splitters"]) for r in got] == [("n", 2)]


def test_csv_rows_like_the_header_and_wide_rows_stay(spark, tmp_path):
    from plumbline.sources import delimited as d
    path = tmp_path / "x.csv"
    path.write_text("id,name\n" + "".join(f'{i},"say ""hi"", you"\n' for i in range(300)) + 'id,name\n7,"two\nlines",extra\n')
    df = d.load(spark, str(path), d.Layout(multiline=True))
    rows = df.collect()
    assert df.columns == ["id", "name", "column_3"] and len(rows) == 302
    assert rows[0]["name"] == 'say "hi", you' and rows[300]["id"] == "id" and rows[301]["name"] == "two\nlines" and rows[301]["column_3"] == "extra"
