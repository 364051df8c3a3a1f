"""N-grams are counted bucket by bucket, with the totals of counting every one."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline import Contract, Measure, Scope
from plumbline.functions import ngrams
from plumbline.operators import growth

ODD = [None, "", " ", "...", "a", "A b", "one two", "one-two, ONE two!", "İstanbul K5 straße", "नमस्ते दुनिया नमस्ते", "कॿखঀग ๆ ไทย क",
       "x😀y z", "a\tb\nc  d\x00e", "ࣿऀ é 9", "tail "]


def _frame(spark, kind, values):
    rnd = random.Random(3)
    words = ["the", "of", "rend", "Ab", "ख", "x1", "é", "zu"]
    texts = ODD + [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(200)]
    return spark.createDataFrame([(t, rnd.choice(values)) for t in texts], f"text string, v {kind}").repartition(3)


def _scope(df):
    return Scope.of(df, Contract("texts", measures=(Measure("v", "sum"),), dimensions=("text",)))


def _plainly(df, n, limit):
    words = F.filter(F.split(F.regexp_replace(F.lower(F.trim("text")), "[^a-z0-9ऀ-ॿ]+", " "), " "), lambda w: w != "")
    df = df.select(words.alias("w"), "v").where(F.size("w") >= n)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    return (df.select(F.explode(F.array_distinct(runs)).alias("ngram"), "v").groupBy("ngram")
            .agg(F.sum("v").cast("double").alias("total"), F.count("*").alias("rows"))
            .orderBy(F.desc_nulls_last("total"), "ngram").limit(limit))


@pytest.mark.parametrize("kind, values", [
    ("long", [1, 2, 50]), ("int", [None, -3, 0, 3]), ("long", [-5, -1]), ("long", [None]),
    ("double", [0.5, -0.25, 1e6, None]), ("double", [1.0, float("inf"), float("-inf"), float("nan"), -2.0])])
@pytest.mark.parametrize("n, limit, buckets, fullest", [(1, 5, 7, 2), (2, 10, 64, 3), (3, 30, 1, 1), (3, 10, 4096, 5), (2, 5000, 64, 3)])
def test_any_buckets_give_the_plain_count(spark, kind, values, n, limit, buckets, fullest):
    df = _frame(spark, kind, values)
    got = growth.text_ngrams(_scope(df), "text", "v", n, limit, buckets=buckets, fullest=fullest).collect()
    assert list(map(repr, got)) == list(map(repr, _plainly(df, n, limit).collect()))


def test_rows_longer_than_a_slice(spark, monkeypatch):
    texts = ["a b c d e f " * 5, "b c d", "", "नमस्ते a b c"] * 3
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, v long")
    want = [tuple(r) for r in _plainly(df, 2, 50).collect()]
    for size in (1, 13, 40, 1 << 20):
        monkeypatch.setattr(ngrams, "SLICE", size)
        batch = pa.RecordBatch.from_arrays([pa.array([t + " " for t in texts]), pa.array(range(len(texts)))], ["t", "v"])
        every = ngrams.runs_in(2, 8, np.ones(8, bool))([batch])
        found = {}
        for part in every:
            for gram, v in zip(part["ngram"].to_pylist(), part["v"].to_pylist()):
                found.setdefault(gram, []).append(v)
        assert sorted((k, float(sum(v)), len(v)) for k, v in found.items()) == sorted(want)


def test_a_task_holds_buckets_not_ngrams(spark, monkeypatch):
    """20,000 different n-grams, one common one: a task keeps a sum per bucket, and n-grams of few buckets."""
    rows = [(f"the end w{i} w{i}x w{i}y", 1) for i in range(5000)]
    df = spark.createDataFrame(rows, "text string, v long").repartition(2)
    kept, stage = [], growth.stage

    def counting(frame):
        kept.append((out := stage(frame)).count())
        return out

    listed, runs_in = [], growth.runs_in
    monkeypatch.setattr(growth, "stage", counting)
    monkeypatch.setattr(growth, "runs_in", lambda n, buckets, wanted: listed.append(int(wanted.sum())) or runs_in(n, buckets, wanted))
    top = growth.text_ngrams(_scope(df), "text", "v", 2, 1, buckets=256, fullest=3).collect()
    assert [tuple(r) for r in top] == [("the end", 5000.0, 5000)]
    assert kept == [256, 1] and listed == [3]


def test_where_all_ngrams_differ_a_task_has_a_share_of_them(spark, monkeypatch):
    """20,000 n-grams of equal worth, so that no bucket can be left out: no task lists nearly all of its partition."""
    rows = [(f"w{i} w{i}x w{i}y", 1) for i in range(10_000)] + [("last one", None)]
    df = spark.createDataFrame(rows, "text string, v long").coalesce(1)
    monkeypatch.setattr(growth, "TOGETHER", 1000, raising=False)
    runs_in = growth.runs_in

    def few_in(n, buckets, wanted):
        def run(batches):
            listed = 0
            for part in runs_in(n, buckets, wanted)(batches):
                listed += part.num_rows
                assert listed < 2000, listed
                yield part
        return run

    monkeypatch.setattr(growth, "runs_in", few_in)
    monkeypatch.setattr(growth, "spread", lambda frame: frame)
    out = growth.text_ngrams(_scope(df), "text", "v", 2, 20, buckets=256, fullest=3)
    assert [tuple(r) for r in out.collect()] == [tuple(r) for r in _plainly(df, 2, 20).collect()]
    shares = re.findall(r"hashpartitioning\(ngram#\d+, (\d+)\)", out._jdf.queryExecution().toString())
    assert shares and min(map(int, shares)) >= 20
