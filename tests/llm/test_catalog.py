import pytest
from oracle import compare, connect

import corpus_pipeline
from plumbline.llm import catalog, jaccard, secrets, toxicity
from plumbline.llm.components import components

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    import re
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES]
    assert sorted(numbers) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    assert compare(catalog.QUERIES[name](spark, SF), connect(SF), catalog.ORACLES[name]) is None


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(50, 60), (60, 70), (55, 70), (80, 81), (90, 90)] + [(100, k) for k in range(101, 150)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 10 for i in range(10, 41)} | dict.fromkeys((50, 55, 60, 70), 50) | {80: 80, 81: 80} | {k: 100 for k in range(100, 150)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, corpus_pipeline.written(stage(spark, kept, SF))
        if name != "packing":
            assert kept.schema == before.schema
        if name == "toxicity":
            gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in kept.collect()}
            clean = [i for i in gone if labels.get(i) == 0]
            assert gone and len(clean) <= 2
        elif name == "near copies":
            groups = {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(before).collect()}
            assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values()))
        elif name == "secrets":
            assert kept.count() == before.count()
            assert all(r["secret_assign"] + r["secret_access"] + r["secret_hex"] == 0 for r in secrets.scan(kept).collect())
        elif name == "mixing":
            assert {r["doc_id"] for r in before.collect()} == {r["doc_id"] for r in kept.collect()}
    last = kept.toPandas()
    assert corpus_pipeline.run(spark, SF).count() == len(last)
    assert last.groupby("sequence_id").length.sum().max() <= 1024


def test_the_rest_does_without():
    import os
    import re
    root = os.path.dirname(corpus_pipeline.__file__)
    for folder, _, files in os.walk(f"{root}/plumbline"):
        if not folder.endswith("llm") and "__pycache__" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"(from|import)\s+[\w.]*\bllm\b", open(f"{folder}/{f}").read()), f
