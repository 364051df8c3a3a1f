import pytest
from pyspark.sql import functions as F

from plumbline.errors import Refused
from plumbline.operators import clean
from plumbline.operators.clean import Action
from plumbline.sources import versions


@pytest.fixture()
def table(spark, tmp_path):
    df = spark.createDataFrame([(1, " a "), (2, "b"), (2, "b"), (3, None)], "id int, name string")
    path = str(tmp_path / "t")
    assert versions.commit(df, path, "load") == 1
    return path


def held(spark, path, version=None):
    return sorted((tuple(r) for r in versions.read(spark, path, version).collect()), key=repr)


def test_apply_keeps_the_version_before_and_undo_returns_to_it(spark, table):
    first = held(spark, table)
    assert clean.cln_apply_version(spark, table, [Action("drop_duplicates"), Action("trim", "name")], note="plan 7") == 2
    assert held(spark, table) == [(1, "a"), (2, "b"), (3, None)] and held(spark, table, 1) == first
    assert versions.undo(spark, table) == 3 and held(spark, table) == first
    assert held(spark, table, 2) == [(1, "a"), (2, "b"), (3, None)]
    rows = {r["version"]: r for r in versions.versions(spark, table).collect()}
    assert [(rows[n]["parent"], rows[n]["kind"], rows[n]["rows"]) for n in (1, 2, 3)] == [(0, "load", 4), (1, "clean", 3), (2, "undo", 4)]
    assert rows[3]["data"] == rows[1]["data"] and rows[3]["fingerprint"] == rows[1]["fingerprint"] and rows[2]["note"] == "plan 7"
    log = [(r["version"], r["step"], r["kind"], r["rows_before"], r["rows_after"]) for r in versions.ledgers(spark, table).orderBy("step").collect()]
    assert log == [(2, 1, "drop_duplicates", 4, 3), (2, 2, "trim", 3, 3)]


def test_a_failed_write_changes_nothing(spark, table):
    first = held(spark, table)
    broken = versions.read(spark, table).withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        versions.commit(broken, table, "clean", parent=1)
    assert held(spark, table) == first and versions.versions(spark, table).count() == 1 and versions.ledgers(spark, table) is None
    # its number stays unused
    assert clean.cln_apply_version(spark, table, [Action("trim", "name")]) == 3
    assert versions.manifest(spark, table)["parent"] == 1 and held(spark, table, 1) == first


def test_of_two_commits_from_one_version_one_is_refused(spark, table):
    df = versions.read(spark, table, 1)
    assert versions.commit(df.limit(1), table, parent=1) == 2
    with pytest.raises(Refused, match="follows"):
        versions.commit(df.limit(2), table, parent=1)
    assert versions.manifest(spark, table)["version"] == 2 and versions.manifest(spark, table)["rows"] == 1


def test_a_reader_keeps_its_version(spark, table):
    mine = versions.read(spark, table)
    clean.cln_apply_version(spark, table, [Action("exclude_column", "name")])
    assert mine.count() == 4 and mine.columns == ["id", "name"] and versions.read(spark, table).columns == ["id"]


def test_refusals(spark, table, tmp_path):
    with pytest.raises(Refused):
        clean.cln_apply_version(spark, table, [])
    with pytest.raises(Refused):
        clean.cln_apply_version(spark, table, [Action("convert_type", "name", {"to": "int"}), Action("trim", "name")])
    with pytest.raises(Refused):
        versions.undo(spark, table)
    with pytest.raises(Refused):
        versions.read(spark, table, 9)
    with pytest.raises(Refused):
        versions.read(spark, str(tmp_path / "none"))
    assert versions.versions(spark, str(tmp_path / "none")).count() == 0 and held(spark, table, 1) == held(spark, table)
