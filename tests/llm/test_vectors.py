import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, neardup, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def crowd(seed=1, n=900, dim=24):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    x[100:160] = x[100] + 0.05 * r.standard_normal((60, dim))  # one crowd of near copies
    for k in range(200, 260, 3):
        x[k + 1] = x[k] + 0.1 * r.standard_normal(dim)
    x[300:330] = x[300]  # equal vectors
    x[331] = 3 * x[332]
    return x.astype(np.float32)


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(5000, None, 1), (5001, [], 1), (5002, [0.0] * 24, 1), (5003, [float("nan")] * 24, 1), (5004, [None] + [1.0] * 23, 1), (5005, [float("inf")] + [1.0] * 23, 1), (5006, [1.0], 1)]


def brute_links(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    alike = u @ u.T >= 0.9
    np.fill_diagonal(alike, False)
    group = np.arange(len(x))
    while True:
        new = np.array([min(group[i], group[np.flatnonzero(alike[i])].min(initial=i)) for i in range(len(x))])
        if (new == group).all():
            return alike.sum(1), group
        group = new


@pytest.mark.parametrize("block", [neardup.BLOCK, 7])
def test_links_equal_brute_force(spark, monkeypatch, block):
    x = crowd()
    links, group = brute_links(x)
    real = neardup.counted
    monkeypatch.setattr(neardup, "counted", lambda u, g, t: real(u, g, t, block))
    out = {r["vec_id"]: r for r in neardup.near_copies(frame(spark, x, ODD)).collect()}
    for i in range(len(x)):
        assert (out[i]["n_links"], out[i]["component_id"]) == (links[i], group[i])
        assert out[i]["kept"] == (i == group[i])
    assert all(out[i]["n_links"] == 0 and out[i]["component_id"] == i and out[i]["kept"] for i, *_ in ODD)


def test_audit_counts_what_is_missing(spark):
    x = crowd(n=400)
    units = frame(spark, x / np.linalg.norm(x, axis=1)[:, None]).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    nothing = spark.createDataFrame([], "id long, links long, nodes long")
    assert neardup.recall(units, nothing, sample=400) == 0.0


def test_search_equals_brute_force(spark):
    x = crowd(2)
    out = ann.search(frame(spark, x, ODD), F.col("vec_id") % 50 == 0).collect()
    d = np.sqrt(((x[:, None, :].astype(float) - x[None].astype(float)) ** 2).sum(-1))
    hits = 0
    for q in range(0, len(x), 50):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        own = d[q].copy()
        own[q] = np.inf
        best = np.lexsort((np.arange(len(x)), own))[:10]
        hits += len({v for _, v, _ in mine} & set(best.tolist()))
        assert [r for r, *_ in mine] == list(range(1, 11)) and all(abs(s - own[v]) < 1e-9 for _, v, s in mine)
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
    assert hits / (10 * len(range(0, len(x), 50))) >= 0.95
    # ties go to the smallest ids
    assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 300] == list(range(301, 311))


def test_small_and_empty_tables(spark):
    few = frame(spark, crowd(n=900)[:4], [(2, [0.5] * 24, 1)])
    out = ann.search(few, F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in out) == [1, 2, 3]
    assert ann.search(frame(spark, []), F.col("vec_id") == 0).count() == 0
    assert neardup.near_copies(frame(spark, [])).count() == 0
    repeated = neardup.near_copies(frame(spark, crowd()[:3], [(1, [float(v) for v in crowd()[1]], 1), (None, [1.0] * 24, 1)])).collect()
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"]) for r in repeated) == [(-1, 0), (0, 0), (1, 0), (1, 0), (2, 0)]


def test_rounds_improve_the_graph(spark):
    x = np.random.default_rng(3).standard_normal((3000, 16))
    rows = frame(spark, x).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    codes = neighbours.coded(rows, neighbours.scale(rows)).cache()
    d = ((x[:200, None] - x[None]) ** 2).sum(-1)
    true = [set(np.argsort(row)[1:11].tolist()) for row in d]

    def recall(lists):
        near = {r["id"]: {n["id"] for n in r["near"]} for r in lists.where("id < 200").collect()}
        return sum(len(true[i] & near[i]) for i in range(200)) / 2000

    first = neighbours.tables(codes, 3000, 12, 2).cache()
    after = neighbours.refined(codes, first, 12)
    assert recall(after) > recall(first) + 0.05


def test_crowds_beyond_full_lists_are_linked(spark):
    r = np.random.default_rng(5)
    a = r.standard_normal(32)
    a /= np.linalg.norm(a)
    b = r.standard_normal(32)
    b -= (b @ a) * a
    b /= np.linalg.norm(b)
    turned = 0.93 * a + np.sqrt(1 - 0.93 ** 2) * b
    x = np.concatenate([c + 0.012 * r.standard_normal((40, 32)) for c in (a, turned)] + [r.standard_normal((200, 32))]).astype(np.float32)
    links, group = brute_links(x)
    assert (group[:80] == 0).all() and links[:40].max() > 39
    out = {q["vec_id"]: q for q in neardup.near_copies(frame(spark, x)).collect()}
    assert [(out[i]["n_links"], out[i]["component_id"]) for i in range(len(x))] == [(links[i], group[i]) for i in range(len(x))]


def test_all_are_compared_where_the_search_fails(spark, monkeypatch):
    x = crowd(n=400)
    links, group = brute_links(x)
    monkeypatch.setattr(neardup, "_verified", lambda lists, units, *_: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(neardup, "full", lambda lists, *_: lists.where("false").select("id"))
    monkeypatch.setattr(neardup, "FURTHER", 0)
    out = {r["vec_id"]: r for r in neardup.near_copies(frame(spark, x)).collect()}
    assert [(out[i]["n_links"], out[i]["component_id"]) for i in range(len(x))] == [(links[i], group[i]) for i in range(len(x))]


def missed(out, x, asked):
    """The true ten nearest that ``out`` lacks."""
    n = 0
    for q in asked:
        own = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(1))
        own[q] = np.inf
        n += len(set(np.lexsort((np.arange(len(x)), own))[:10].tolist()) - {r["vec_id"] for r in out if r["query_id"] == q})
    return n


def test_long_vectors_and_close_copies_leave_the_others_found(spark, monkeypatch):
    x = crowd(4, n=1200)
    x[600:1000] = x[600] + 0.001 * np.random.default_rng(6).standard_normal((400, 24))
    x[7] *= 1000
    monkeypatch.setattr(ann, "exhaustive", None, raising=False)  # found on the walk
    asked = range(0, 1200, 25)
    out = ann.search(frame(spark, x), F.col("vec_id") % 25 == 0).collect()
    assert missed(out, x, asked) <= 0.05 * 10 * len(asked)


def test_queries_meet_all_rows_where_the_search_fails(spark, monkeypatch):
    x = crowd(2)
    monkeypatch.setattr(ann, "walk", lambda state, *_, **__: state)
    monkeypatch.setattr(ann, "QUERIES", 5)
    out = ann.search(frame(spark, x, ODD), F.col("vec_id") % 50 == 0).collect()
    assert len(out) == 180 and missed(out, x, range(0, len(x), 50)) == 0


def test_estimates_do_not_grow_with_the_hops(spark):
    """A query that walks along a chain: sizes that each hop's joins multiply took the driver's memory and time."""
    n = 12
    codes = spark.createDataFrame([(i, np.array([i, 0], dtype=ann.CODE).tobytes()) for i in range(n)], "id long, code binary")
    edges = spark.createDataFrame([(i, [j for j in (i - 1, i + 1) if 0 <= j < n]) for i in range(n)], "id long, others array<bigint>")
    start = codes.where("id = 0").select(
        F.col("id").alias("query"), "code", F.array("id").alias("ids"), F.array(F.lit(0.0)).alias("ds"), F.array(F.lit(False)).alias("done"),
        F.array("id").alias("seen"), F.array("id").alias("front"), F.lit(1).alias("open"))
    out = ann.walk(start, edges, codes, width=2 * n, beam=1, k=3, settle=False)
    assert [sorted(r["ids"]) for r in out.collect()] == [list(range(n))]
    assert len(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 20


def turned(r, angle_cosine, dim=32):
    """Two unit vectors with that cosine."""
    a = r.standard_normal(dim)
    a /= np.linalg.norm(a)
    b = r.standard_normal(dim)
    b -= (b @ a) * a
    b /= np.linalg.norm(b)
    return a, angle_cosine * a + np.sqrt(1 - angle_cosine ** 2) * b


@pytest.mark.parametrize("size", [20, 70, 400])
def test_saturated_lists_grow_until_crowds_are_joined(spark, monkeypatch, size):
    r = np.random.default_rng(size)
    pairs = [turned(r, 0.93), turned(r, 0.94), turned(r, 0.8)]  # the last two stay apart
    x = np.concatenate([c + 0.01 * r.standard_normal((size, 32)) for pair in pairs for c in pair] + [r.standard_normal((150, 32))]).astype(np.float32)
    links, group = brute_links(x)
    assert group[size] == 0 and group[5 * size] == 5 * size
    monkeypatch.setattr(neardup, "everywhere", None)  # found by the lists alone
    out = {q["vec_id"]: q for q in neardup.near_copies(frame(spark, x)).collect()}
    assert [(out[i]["n_links"], out[i]["component_id"]) for i in range(len(x))] == [(links[i], group[i]) for i in range(len(x))]


def test_new_places_go_to_other_components(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([c + 0.01 * r.standard_normal((60, 32)) for c in turned(r, 0.93)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    units = frame(spark, x).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    scale = neighbours.scale(units)
    codes = neighbours.coded(units, scale).cache()
    lists = neighbours.graph(codes, 120, 16).cache()
    assert neardup.full(lists, scale).count() == 120
    own = units.select("id", F.floor(F.col("id") / 60).cast("long").alias("component"))
    more = {q["id"]: [n["id"] for n in q["near"]] for q in neardup.beyond(codes, lists, own, units.select("id"), 8).collect()}
    # 120 vectors are one block: the lists are exact among codes
    c = np.rint(x.astype(np.float32).astype(float) * scale)
    d = ((c[:, None] - c[None]) ** 2).sum(-1)
    d[np.arange(120)[:, None] // 60 == np.arange(120) // 60] = np.inf
    for i in range(120):
        assert len(more[i]) == 8 and sorted(d[i, more[i]]) == np.sort(d[i])[:8].tolist()


def test_audit_weighs_nodes_alike(spark):
    x = np.concatenate([np.tile([1.0, 0.0], (40, 1)) + 0.001 * np.arange(40)[:, None], [[0.0, 1.0], [0.01, 1.0]]])
    units = frame(spark, x / np.linalg.norm(x, axis=1)[:, None]).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    crowd_only = spark.createDataFrame([(i, 39, 39) for i in range(40)], "id long, links long, nodes long")
    assert abs(neardup.recall(units, crowd_only, sample=42) - 40 / 42) < 1e-9
