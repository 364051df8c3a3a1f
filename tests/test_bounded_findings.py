"""Findings over columns with many forms or nearly unique pairs."""

from plumbline.operators import keys, quality


def test_many_forms_are_counted_and_listed_elsewhere(spark):
    rows = [(" " * i + "web",) for i in range(40)] + [("Web",)] * 3 + [("shop",)] * 5 + [(None,)]
    df = spark.createDataFrame(rows, "source string")
    whole = quality.dq_spellings(df, ["source"]).first()
    assert whole["rows"] == 43 and whole["detail"].count(" / ") == 40
    short = quality.dq_spellings(df, ["source"], most=2).collect()
    assert [(r["rows"], r["detail"]) for r in short] == [(43, " " * 39 + "web / Web / +39")]  # ties: the smaller text
    forms = quality.spelling_forms(df, "source").collect()
    assert len(forms) == 41 and sum(r["n"] for r in forms) == 43 and {r["k"] for r in forms} == {"web"}


def test_one_repeat_in_any_place_refutes_a_pair(spark):
    def table(repeated):
        rows = [(i // 50, i % 50) for i in range(2500)]
        rows[7] = rows[repeated]
        return spark.createDataFrame(rows, "store_id long, line_id long")

    def found(df):
        return [r["columns"] for r in keys.key_candidates(df).collect()]

    assert found(table(7)) == ["store_id,line_id"]
    for repeated in (0, 8, 1234, 2499):
        assert found(table(repeated)) == []


def test_a_table_smaller_than_a_slice(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "store_id long, line_id long")
    assert [r["columns"] for r in keys.key_candidates(df).collect()] == ["store_id,line_id"]
