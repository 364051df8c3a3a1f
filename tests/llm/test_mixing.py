import math
from collections import Counter

import pytest

from plumbline.llm import mixing


def docs_of(documents):
    rows = [(i, "w " * 10, "big") for i in range(80)] + [(100 + i, "w " * 10, "mid") for i in range(20)]
    rows += [(200 + i, "w " * 10, None) for i in range(5)] + [(300, None, "silent"), (301, "", "silent")]
    return documents(rows)


def test_entropy_is_met_and_every_row_is_there(spark, documents):
    docs = docs_of(documents)
    out = mixing.mix(docs, entropy=0.97, blocks=4).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in docs.collect()}
    tokens = Counter()
    for r in out:
        tokens[r["source"]] += len((r["text"] or "").split())
    p = [t / sum(tokens.values()) for t in tokens.values() if t]
    assert -sum(x * math.log(x) for x in p) >= 0.95 * math.log(3)
    assert tokens["silent"] == 0 and {r["mix_pass"] for r in out if r["source"] == "big"} == {0}
    # every block holds every source in about its weight
    blocks = Counter((r["mix_block"], r["source"]) for r in out)
    assert all(blocks[b, "big"] >= 8 for b in range(4))


def test_repetition_limit(spark, documents):
    sources = {r["source"]: r for r in mixing.plan(docs_of(documents), repetition=2.0).collect()}
    assert max(r["target"] / r["tokens"] for r in sources.values() if r["tokens"]) <= 2.01
    assert sources[None]["target"] / sources[None]["tokens"] > 1.9


def test_budget_cuts_a_pass_by_whole_documents(spark, documents):
    out = mixing.mix(documents([(i, "w " * 10, "a") for i in range(50)]), entropy=0.9, budget=255).collect()
    assert len(out) == 25
    twice = mixing.mix(documents([(i, "w " * 10, "a") for i in range(50)]), entropy=0.9, budget=1255).collect()
    assert Counter(Counter(r["doc_id"] for r in twice).values()) == {2: 25, 3: 25}


def test_exponent_agrees_with_plain_bisection(spark):
    tokens = [1000, 300, 50, 7]
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(tokens)], "source string, tokens long")

    def entropy(a):
        w = [t ** a for t in tokens]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    low, high = 0.0, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= 0.9 * math.log(4) else (low, mid)
    assert mixing.exponent(frame, entropy=0.9) == pytest.approx(low, abs=1e-8)


def test_repeated_rows_and_other_columns(spark, documents):
    docs = documents([(1, "a b", "s", 5), (1, "a b", "s", 5), (None, "c", "s", 6)], ", mix_pass int")
    out = mixing.mixed_documents(docs, repetition=1.0)
    assert out.columns == docs.columns and sorted(r["mix_pass"] for r in out.collect()) == [5, 5, 6]
    assert {r["mix_pass"] for r in mixing.mix(docs, repetition=1.0).collect()} == {0}


def test_empty_table(spark, documents):
    assert mixing.mix(documents([]), entropy=0.9).count() == 0
