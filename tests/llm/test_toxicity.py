import random
import zlib

from pyspark.sql import functions as F

from plumbline.llm import toxicity


def corpus(n=600):
    r = random.Random(3)
    words = ["river", "stone", "garden", "window", "paper", "market", "silver", "evening", "bridge", "forest"]
    rows, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(1, len(text) // 10)):
                text[r.randrange(len(text))] = r.choice(["gribnak", "zorvul"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus()
    out = toxicity.classify(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    unseen = [r for r in out if r["held_out"]]
    assert len(out) == 600 and len(unseen) > 60
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in unseen) / len(unseen) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)


def test_nulls_empty_and_repeated_rows(spark, documents):
    rows, labels = corpus(100)
    docs = documents(rows + [(900, None), (901, ""), (None, "text"), (1, "again")])
    out = toxicity.classify(docs, spark.createDataFrame(labels + [(1, None), (7777, 1), (2, 1), (2, 0)], "doc_id long, toxic int")).collect()
    assert len(out) == 104 and all(r["score"] is not None for r in out)


def test_without_both_classes(spark, documents):
    docs = documents([(1, "a"), (2, "b")])
    none = toxicity.classify(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.agg(F.max("score")).first()[0] < 1e-6
    assert toxicity.classify(documents([]), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_the_sample_is_bounded(spark, documents):
    rows, labels = corpus(200)
    known = toxicity.labelled(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.held_out(), sample=50)
    assert known.count() == 50
