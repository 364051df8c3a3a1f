import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.sources import delimited as d
from plumbline.sources import multiline as m

TRICKY = ('a,"x\r\ny",1\n"q ""in"" side",b,2\n\n\nplain,5" disk,3\n"""",",",4\n"one\n\n\ntwo\n,""\n",c,5\n"ab"cd,e,6\n'
          '" lead",f,7\n"é\nü,\n",g,8\nz,"","9"\n"last\nopen ""\n,')


@pytest.fixture()
def parted(spark):
    """Reads with ranges of a given number of bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}

    def use(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")
    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def put(folder, name, text, encoding="utf-8"):
    path = os.path.join(str(folder), name)
    with open(path, "wb") as f:
        f.write(text.encode(encoding))
    return path


def by_one_task(spark, path, width):
    options = {**d._options(d.Layout(multiline=True)), "lineSep": "\n"}
    return [tuple(r) for r in spark.read.options(**options).schema(d._schema(width)).csv(path).collect()]


def placed(df, width):
    rows = df.orderBy("__file", "__block", "__row").collect()
    return [tuple(r)[:width] for r in rows]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 8, 9, 11, 13, 16, 17, 19, 23, 40, 60, 1000])
def test_every_split_point(spark, parted, tmp_path, size):
    path = put(tmp_path, "t.csv", TRICKY)
    want = by_one_task(spark, path, 4)
    parted(size)
    got = d.raw(spark, path, d.Layout(multiline=True), 4)
    assert placed(got, 4) == want
    assert size > 30 or m._lines(spark, path, "UTF-8").rdd.getNumPartitions() > 3


def test_random_files(spark, parted, tmp_path):
    r = random.Random(3)
    for n in range(6):
        folder = tmp_path / f"f{n}"
        folder.mkdir()
        for k in range(3):
            cells = [["".join(r.choice('ab",\n\r ') for _ in range(r.randrange(9))) for _ in range(3)] for _ in range(40)]
            text = "\n".join(",".join('"' + c.replace('"', '""') + '"' if set(c) & set('",\n\r ') or r.random() < 0.3 else c for c in row) for row in cells)
            put(folder, f"{k}.csv", text)
        want = sorted(by_one_task(spark, str(folder), 3), key=repr)
        parted(r.choice([16, 50, 120]))
        got = d.raw(spark, str(folder), d.Layout(multiline=True), 3)
        assert sorted(placed(got, 3), key=repr) == want


def test_rows_that_end_in_two_characters(spark, parted, tmp_path):
    path = put(tmp_path, "t.csv", TRICKY.replace("\r", "").replace("\n", "\r\n"))
    want = [tuple(c and c.replace("\r", "") for c in r) for r in by_one_task(spark, put(tmp_path, "u.csv", TRICKY.replace("\r", "")), 4)]
    for size in (4, 31):
        parted(size)
        got = [tuple(c and c.replace("\r", "") for c in r) for r in placed(d.raw(spark, path, d.Layout(multiline=True), 4), 4)]
        assert got == want


def test_state_is_composed_over_many_ranges(spark):
    """Ranges that keep, turn and forget the state, against running through them."""
    r = random.Random(9)
    kinds = {"keep": [False, True], "turn": [True, False], "out": [False, False], "in": [True, True]}
    rows, want = [], {}
    for f in range(20):
        state = False
        for b in range(30):
            ends = kinds[r.choice(["keep", "turn", "turn", "out", "in"][:r.randint(2, 5)])]
            want[f"f{f}", b] = state
            rows.append((f"f{f}", b, ends, [0, 0], [0, 0], [0, 0]))
            state = ends[state]
    df = spark.createDataFrame(rows, "__file string, __block long, ends array<boolean>, head array<long>, last array<long>, prior array<long>")
    assert {(x["__file"], x["__block"]): x["inside"] for x in m.started(df).collect()} == want


def test_load_with_headers_footer_and_breaks(spark, parted, tmp_path):
    head = 'Report\n"Order\nID",Note\n'
    body = "".join(f'{i},"line {i}\nof ""{i}"", more"\n' for i in range(60))
    for part in ("a", "b"):
        put(tmp_path, f"{part}.csv", head + body)
    want = sorted((i, f'line {i}\nof "{i}", more') for i in range(60)) * 2
    parted(90)
    df = d.load(spark, str(tmp_path), d.Layout(skip=1, multiline=True, dtypes={"order_id": "int"}))
    assert df.columns == ["order_id", "note"] and sorted(map(tuple, df.collect())) == sorted(want)
    one = d.load(spark, str(tmp_path / "a.csv"), d.Layout(skip=1, multiline=True, footer=2))
    assert one.count() == 58


def test_other_encodings_and_a_byte_order_mark(spark, parted, tmp_path):
    text = 'é,"ü\n, ä"\nß,"x"\n'
    want = [("é", "ü\n, ä"), ("ß", "x")]
    parted(5)
    for encoding in ("iso-8859-1", "utf-16"):
        path = put(tmp_path, f"{encoding}.csv", text, encoding)
        assert sorted(placed(d.raw(spark, path, d.Layout(multiline=True, encoding=encoding), 2), 2)) == sorted(want)
    path = put(tmp_path, "bom.csv", "﻿" + text)
    assert placed(d.raw(spark, path, d.Layout(multiline=True), 2), 2) == want


def test_many_tasks_and_only_crossing_rows_move(spark, parted, tmp_path):
    path = put(tmp_path, "t.csv", "".join(f'{i},"a\nb {i}"\n' for i in range(5000)))
    parted(4000)
    df = m.records(spark, path, ",")
    assert df.count() == 5000 and df.rdd.getNumPartitions() > 10
    moved = df.groupBy("__file", "__block").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert moved < 1000


def test_empty_file(spark, tmp_path):
    path = put(tmp_path, "e.csv", "")
    assert m.records(spark, path, ",").count() == 0
