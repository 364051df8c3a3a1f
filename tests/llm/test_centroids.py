import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import centroids

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def vectors(n, seed, dims=64, spread=0.1):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [x + r.gauss(0, spread) for x in r.choice(centres)], None) for i in range(n)]


def brute(rows, k=8, rounds=10):
    """id: (cluster, distance), inertia per cluster and digests, by plain integers; rows may repeat."""
    kept = [(i, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        own = [n for _, n in assign()]
        for n in range(len(centres)):
            members = [v for (_, v), m in zip(kept, own) if m == n]
            if members:
                centres[n] = [sum(x) // len(members) for x in zip(*members)]
    got = assign()
    inertia = {n: sum(d for d, m in got if m == n) for n in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), n, d, inertia[n], sum(inertia.values()), digest[n]) for (i, _), (d, n) in zip(kept, got))


def clustered(spark, rows, schema=EMBEDDINGS):
    out = centroids.cluster(spark.createDataFrame(rows, schema))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_against_brute_force(spark, spread):
    rows = vectors(400, 3, spread=spread)
    assert clustered(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(60, 5)
    rows += rows[:20] + [(None, rows[3][1], 1), (None, rows[4][1], 1), (7, rows[9][1], 2)]  # repeated rows and ids, no id
    rows += [(100, None, 0), (101, [], 0), (102, [1.0] * 63, 0), (103, [1.0] * 63 + [None], 0), (104, [float("nan")] * 64, 0),
             (105, [float("inf")] + [0.0] * 63, 0), (106, [0.0] * 64, 0), (107, [3e38] * 64, 0)]
    assert clustered(spark, rows) == brute(rows[:-1])


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2)] * 64, None) for i in range(40)]
    got = clustered(spark, rows)
    assert got == brute(rows) and len({r[1] for r in got}) == 2


def test_fewer_rows_than_clusters_and_none(spark):
    rows = vectors(3, 8)
    assert clustered(spark, rows) == brute(rows)
    assert clustered(spark, []) == [] and clustered(spark, [(1, None, 1)]) == []


def test_large_components(spark):
    rows = vectors(50, 9) + [(200, [1e6] * 64, 0), (201, [-1e6] * 64, 0), (202, [2e9] * 64, 0)]
    got = {r[0]: r for r in clustered(spark, rows)}
    want = {r[0]: r for r in brute(rows)}
    for i, row in want.items():
        assert got[i] == tuple(x if not isinstance(x, int) or x < 2 ** 63 else None for x in row)


def test_clashing_columns(spark):
    rows = [(*r, 1, 2, "x") for r in vectors(30, 11)]
    schema = EMBEDDINGS + ", cluster int, distance long, centroid_sha256 string"
    assert clustered(spark, rows, schema) == brute(rows)


def test_bounds_never_exceed_the_distance_and_save_work():
    r = np.random.default_rng(1)
    centres = r.integers(-1000, 1000, (8, 64))
    m = centres[r.integers(0, 8, 2000)] + r.integers(-60, 60, (2000, 64))
    pairs = centroids.pivot_pairs(m[:16].tolist())
    near = centroids._pivot_distances(m, pairs)
    between = np.array([np.sqrt(float(((np.array(p) - np.array(s)) ** 2).sum())) for p, s in pairs])
    for c in centres:
        low = centroids.bounds(near, centroids._pivot_distances(c[None], pairs)[0], between)
        assert (low ** 2 <= ((m - c) ** 2).sum(axis=1)).all()
    cluster, distance, measured = centroids.nearest(m, near, centres, pairs)
    all_distances = ((m[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (cluster == all_distances.argmin(axis=1)).all() and (distance == all_distances.min(axis=1)).all()
    assert measured < 2000 * 8 / 2
