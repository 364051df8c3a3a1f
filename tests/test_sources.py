"""Files, database options, stored results and streams."""

import pytest
from pyspark.sql import functions as F

from plumbline import Contract, Refused, Window
from plumbline.operators import clean, keys, validate
from plumbline.sources import delimited as d
from plumbline.sources import jdbc
from plumbline.sources import results as r
from plumbline.streaming import microbatch


def test_header_names():
    assert d.header_names([["Order ID", "Unit Price", "", "Order ID"]]) == ["order_id", "unit_price", "column_3", "order_id_2"]
    two = [["Sales", "", "Cost"], ["Units", "Value", "Value"]]
    assert d.header_names(two) == ["sales_units", "value", "cost_value"]
    assert d.header_names(two, fill=True) == ["sales_units", "sales_value", "cost_value"]
    assert d.header_names(two, join="bottom_only") == ["units", "value", "value_2"]


def test_guess_layout_and_delimiter():
    lines = ["Quarterly report", "Name;Amount;Day", "a;1,5;2024-01-01", "b;2,5;2024-01-02"]
    g = d.guess_layout(lines)
    assert (g.delimiter, g.skip, g.header_rows) == (";", 1, 1)


def test_period_columns():
    assert d.period_columns(["region", "Jan", "Feb", "Mar"]) == ["Jan", "Feb", "Mar"]
    assert d.period_columns(["region", "city", "2024-01", "2024-02"]) == []
    assert d.period_columns(["id", "2024", "2025", "2026"]) == ["2024", "2025", "2026"]


def test_load_reads_every_row(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("Title\nOrder,Price,Note,\n1,2.5,ok,\n2,x,N/A,\n3,4.0,,\ntotal,9,,\n")
    layout = d.Layout(skip=1, na_values=("", "N/A"), footer=1, dtypes={"order": "bigint", "price": "double"})
    df = d.drop_trailing_empty(d.load(spark, str(p), layout, on_error="null"))
    assert df.columns == ["order", "price", "note"]
    assert [tuple(x) for x in df.orderBy("order").collect()] == [(1, 2.5, "ok"), (2, None, None), (3, 4.0, None)]
    with pytest.raises(Exception):
        d.load(spark, str(p), layout).collect()


def test_jdbc_options_push_to_the_source():
    o = jdbc.table_options("jdbc:x", "orders", where="day > '2024-01-01'", limit=10)
    assert o["dbtable"] == '(SELECT * FROM "public"."orders" WHERE day > \'2024-01-01\' LIMIT 10) AS source'
    p = jdbc.table_options("jdbc:x", "or\"ders", schema="s", partition=("id", 0, 100, 8))
    assert p["dbtable"] == '"s"."or""ders"' and p["numPartitions"] == "8"
    assert jdbc.checked_select("  select 1 ") == "select 1"
    for bad in ("delete from t", "select 1; drop table t", "update t set a = 1"):
        with pytest.raises(Refused):
            jdbc.checked_select(bad)


def test_snapshot_ignores_order_and_sees_changes(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    a, b = r.snapshot(df).first(), r.snapshot(df.orderBy(F.desc("id")).repartition(5)).first()
    assert a == b
    assert r.snapshot(df.where("id <> 3")).first()["fingerprint"] != a["fingerprint"]


def test_clean_conflicts_and_locale_proposals(spark):
    df = spark.createDataFrame([(f"{i},{i:03d}", f" v{i % 3} ") for i in range(1, 60)], "n string, s string")
    plan = [tuple(x) for x in clean.cln_detect(df).select("kind", "column", "options").collect()]
    assert ("convert_type", "n", "reading=us, to=bigint") in plan
    assert any(k == "convert_type" and "reading=eu" in o for k, _, o in plan)      # ambiguous: both offered
    both = [clean.Action("convert_type", "n", {"to": "bigint", "reading": x}) for x in ("us", "eu")]
    with pytest.raises(Refused):
        clean.cln_apply(df, both)
    with pytest.raises(Refused):
        clean.cln_apply(df, [both[0], clean.Action("trim", "n")])


def test_date_formats(spark):
    texts = ["2024-03-05", "2024-03-05 10:11:12", "2024/03/05", "Mar 5, 2024", "March 5, 2024", "5 mar 2024", "05-Mar-2024",
             "20240305", "05/03/2024", "5.3.24", "31/12/69", "31/12/68", "hello"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = {x["t"]: x["d"] for x in df.select("t", clean.read_dates(F.col("t"), "day").cast("date").cast("string").alias("d")).collect()}
    assert all(got[x] == "2024-03-05" for x in texts[:10]), got
    assert got["31/12/69"] == "1969-12-31" and got["31/12/68"] == "2068-12-31" and got["hello"] is None


def test_action_ids_are_stable():
    a = clean.Action("convert_type", "x", {"to": "bigint", "reading": "us"})
    assert a.id == clean.Action("convert_type", "x", {"reading": "us", "to": "bigint"}).id
    assert a.id != clean.Action("convert_type", "y", {"to": "bigint", "reading": "us"}).id


def test_claims():
    cols = ["price", "city"]
    assert keys.parse_claim("12 rows where price < 0", cols)[0] == "compare"
    assert keys.parse_claim("3 rows have city 'n/a'", cols) == ("token", {"claimed": 3, "column": "city", "value": "n/a"})
    assert keys.parse_claim("city is empty in 1,204 rows", cols) == ("blank", {"claimed": 1204, "column": "city"})
    assert keys.parse_claim("prices look odd", cols)[0] == "unchecked"


def test_validation_over_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    for part in (range(0, 50), range(50, 120)):
        spark.createDataFrame([(i, f"2024-01-{i % 28 + 1:02d}", i - 10.0) for i in part], "id int, d string, x double").withColumn(
            "d", F.to_date("d")).coalesce(1).write.mode("append").parquet(str(src))
    c = Contract("s", key=("id",), date_column="d", window=Window("2024-01-01", "2024-01-15"))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = microbatch.per_batch(stream, lambda b: validate.val_report(b, c, "2025-01-01"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {x["check"]: x for x in microbatch.check_totals(spark.read.parquet(str(tmp_path / "out"))).collect()}
    whole = {x["check"]: x for x in validate.val_report(spark.read.parquet(str(src)), c, "2025-01-01").collect()}
    for k in got:
        assert (got[k]["rows"], got[k]["passed"], got[k]["failed"]) == (whole[k]["rows"], whole[k]["passed"], whole[k]["failed"])


def test_load_finds_breaks_and_stray_quotes_anywhere(spark, tmp_path):
    late = tmp_path / "late.csv"
    late.write_text("id,price,note\n" + "".join(f"{i},{i}.5,n\n" for i in range(300)) + '300,1.5,"two\nlines"\n301,2.5,n\n')
    df = d.load(spark, str(late))
    assert df.count() == 302 and df.where("id = '300'").first()["note"] == "two\nlines"
    stray = tmp_path / "stray.csv"
    stray.write_text("id,price,note\n" + '1,2.5,5" pipe\n2,3.5,n\n' + '3,4.5,"a ""b"", c"\n')
    assert d.load(spark, str(stray)).count() == 3
    assert not d.table_broken(spark, str(stray), ",") and d.table_broken(spark, str(late), ",")
    parts = tmp_path / "parts"
    parts.mkdir()
    (parts / "a.csv").write_text("id;price\n1;2,5\n")
    (parts / "b.csv").write_text("".join(f'{i};3,5\n' for i in range(2, 50)) + '50;"x\ny"\n')
    assert d.load(spark, str(parts)).count() == 50
