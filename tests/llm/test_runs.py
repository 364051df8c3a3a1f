import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import catalog, runs


def brute(w, times=3, least=24):
    """Every stretch whose words equal those q on, whose smallest period is q."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size, s = j - i + q, w[i:j + q]
            if size >= max(least, times * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(r, n, k):
    w = [r.randrange(k) for _ in range(n)]
    for _ in range(r.randrange(4) if n else 0):
        a = r.randrange(n)
        p, e = r.randint(1, max(1, (n - a) // 3)), r.randint(a, n)
        w[a:e] = [w[a + i % p] for i in range(e - a)]
    return w


def test_lyndon_array():
    r = random.Random(1)
    for _ in range(800):
        w = [r.randrange(r.randint(1, 4)) for _ in range(r.randint(1, 40))]
        want = [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) - i for i in range(len(w))]
        assert runs.lyndon(w) == want


@pytest.mark.parametrize("times, least", [(3, 24), (2, 2), (2, 10), (3, 3), (4, 9), (5, 40)])
def test_against_brute_force(times, least):
    r = random.Random(times * 100 + least)
    for _ in range(300):
        w = repetitive(r, r.randint(0, 150), r.choice([2, 3, 50]))
        assert runs.runs(w, times, least) == brute(w, times, least)


def test_hashes_that_agree_wrongly(monkeypatch):
    """Words whose hashes are equal throughout: extensions are then compared word by word."""
    r = random.Random(4)
    monkeypatch.setattr(runs.hashing, "mixed", lambda v, *a: v * 0)
    for _ in range(100):
        w = repetitive(r, r.randint(0, 120), 5)
        assert set(runs.runs(w)) == set(brute(w))


def planted(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, words):
    found = brute(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    drop = {i for a, n, q in found for i in range(a + q, a + n)}
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *best, best[2] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_on_the_smallest_corpus(spark, sample):
    got = {r["doc_id"]: tuple(r) for r in catalog.QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    short = {i for i, t in sample.items() if len(t.split()) < 1500}
    assert set(got) == set(sample) and any(got[i][1] for i in short)
    for i in short:
        assert got[i] == expected(i, planted(i, sample[i]))


def test_odd_texts(spark, documents):
    texts = [None, "", " \t\n", "a " * 23, "a " * 24, "a b c " * 8, "a b c " * 7 + "a b", "é ü\x0b" * 20, "x\x85x " * 30, "a b " * 30,
             "b " * 30 + "a " * 30, " ".join(map(str, range(500))) + " q" * 500, "one two " * 40000]
    docs = documents([(i, t) for i, t in enumerate(texts)] * 2 + [(None, "z " * 30)])
    got = sorted((tuple(r) for r in runs.scan(docs).drop("text", "lang", "source", "n_chars", "run_collapsed").collect()), key=repr)
    want = [expected(i, (t or "").encode().split()) for i, t in list(enumerate(texts[:-1])) * 2 + [(None, "z " * 30)]]
    long = (len(texts) - 1, 1, 0, 80000, 2, 40000000, hashlib.sha256(b"0,80000,2\n").hexdigest(), hashlib.sha256(b"one two").hexdigest())
    assert got == sorted(want + [long] * 2, key=repr)


def test_collapsed_text_and_clashing_columns(spark, documents):
    docs = documents([(1, "head " + "a b " * 20 + "tail", "s", 9)], ", run_start int")
    row = runs.scan(docs).first()
    assert row["run_collapsed"] == "head a b tail" and row["run_start"] == 1 and row["doc_id"] == 1
    assert runs.scan(documents([])).count() == 0


def test_planting(spark, documents):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 70))) for i in range(200)] + [(None, "a b c"), (5, None)]
    got = sorted(((r["doc_id"], (r["text"] or "").split()) for r in runs.repeating(documents(rows)).collect()), key=repr)
    assert got == sorted(((i, [w.decode() for w in planted(i, t)]) for i, t in rows), key=repr)
    extra = documents([(10, "a b c d", "s", 1)], ", n int")
    assert runs.repeating(extra).columns == extra.columns and runs.repeating(documents([])).select(F.col("text")).count() == 0
