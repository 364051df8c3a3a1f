"""Centroid clustering of integer vectors, with Ptolemaic pivots to leave out most distances.

Rows are assigned to the nearest of ``k`` centroids and centroids are moved to the floor of their members' mean, in rounds.
For each row the distances to ``PAIRS`` fixed pairs of pivots (rows themselves) are measured once and kept beside the vector.
By Ptolemy's inequality, |d(x,p) d(c,s) - d(x,s) d(c,p)| / d(p,s) is a lower bound of d(x,c) for every pivot pair (p, s). In a
round a row is measured against the centroid with the smallest bound, then against those whose bound doesn't exceed what has
been found; bounds are rounded down by more than floating point can have added, and what they leave open is decided by exact
integers. A bound equal to the best distance is checked too, so ties go to the smaller number.

Vectors are staged once on shared storage. A round is one pass over them: each task sums its members per cluster and sends
``k`` x ``dims`` sums; the driver receives as many. What a task holds is a batch of rows, whatever a cluster's share of them.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part; neither do those
with a component of 2**52 or more after scaling, which a double doesn't hold to the unit. A null id hashes like the empty id.
Rows that repeat an id are rows of their own, ordered by the vector where the hash ties; rows equal in both may each start a
centroid, the second of which stays empty. Fewer rows than ``k`` start as many centroids. No rows: an empty result. Distances
and inertias that don't fit a long are null. Extra columns of the input aren't carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Pivot pairs, fixed for all rounds.
PAIRS = 8
#: Rows measured at a time.
ROWS = 4096
#: More than the relative error of a bound's terms: products of two roots, each off by a few units in the last place.
_SLACK = 1e-13
#: Components below this are exact in doubles and fit a long.
_LARGEST = 2.0 ** 52


def integers(table: DataFrame, id_: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """id (long), v (array<long>: the floor of scaled components) of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale < _LARGEST))
    kept = F.col(vector).isNotNull() & (F.size(vector) == dims) & F.coalesce(fine, F.lit(False))
    # guarded, so that other vectors aren't scaled before they are left out
    scaled = F.when(kept, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))
    return table.where(kept).select(F.col(id_).cast("long").alias("id"), scaled.alias("v"))


def first_rows(rows: DataFrame, n: int, seed: int = SEED) -> list[list[int]]:
    """The ``n`` vectors whose ids have the smallest hash, in that order; ties by the vector."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in rows.select(key.alias("key"), "v").orderBy("key", "v").limit(n).collect()]


def exact(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``m`` from ``c``: int64, or Python integers where these could overflow."""
    if m.size and (int(np.abs(m).max()) + int(np.abs(c).max())) ** 2 * m.shape[1] >= 2 ** 62:
        m, c = m.astype(object), c.astype(object)
    d = m - c
    return (d * d).sum(axis=1)


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def pivot_pairs(points: list[list[int]]) -> list[tuple[list[int], list[int]]]:
    """Successive pairs of ``points`` that differ."""
    pairs = []
    for p, s in zip(points[::2], points[1::2]):
        if p != s:
            pairs.append((p, s))
    return pairs


def _pivot_distances(m: np.ndarray, pairs) -> np.ndarray:
    """Distances from each row to both pivots of every pair: rows x pairs x 2."""
    out = np.empty((len(m), len(pairs), 2))
    for k, pair in enumerate(pairs):
        for side in (0, 1):
            out[:, k, side] = roots(exact(m, np.array(pair[side], dtype=np.int64)))
    return out


def bounds(near: np.ndarray, centroid: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Lower bounds of the distance to a centroid, at most the true ones: rows.

    ``near``: rows x pairs x 2 (distances to p and s), ``centroid``: pairs x 2, ``between``: pairs (distance of p and s).
    """
    if not len(between):
        return np.zeros(len(near))
    a, b = near[:, :, 0] * centroid[:, 1], near[:, :, 1] * centroid[:, 0]
    low = np.abs(a - b) - (a + b) * _SLACK
    return np.maximum(low / between, 0.0).max(axis=1) * (1.0 - _SLACK)


def nearest(m: np.ndarray, near: np.ndarray, centroids: np.ndarray, pairs) -> tuple[np.ndarray, np.ndarray, int]:
    """The cluster of each row, its squared distance, and how many distances were measured."""
    between = np.array([float(roots(exact(np.array([p]), np.array(s)))[0]) for p, s in pairs])
    to_pivots = _pivot_distances(centroids, pairs)
    low = np.stack([bounds(near, to_pivots[c], between) for c in range(len(centroids))], axis=1)
    low = low * low * (1.0 - _SLACK)
    first = low.argmin(axis=1)
    cluster, best, measured = first.copy(), np.zeros(len(m), dtype=np.int64), len(m)
    for c in np.unique(first):
        d = exact(m[first == c], centroids[c])
        best = best.astype(np.result_type(best, d))
        best[first == c] = d
    for c in range(len(centroids)):
        # a double of an exact distance is off by one part in 2**53 at most
        at = np.flatnonzero((first != c) & (low[:, c] <= best.astype(np.float64) * (1.0 + _SLACK)))
        if not len(at):
            continue
        measured += len(at)
        d = exact(m[at], centroids[c])
        best = best.astype(np.result_type(best, d))
        better = (d < best[at]) | ((d == best[at]) & (c < cluster[at]))
        best[at[better]] = d[better]
        cluster[at[better]] = c
    return cluster, best, measured


def _batches(batch, pairs: int):
    """id, vectors, pivot distances of a staged batch, ``ROWS`` at a time."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        m = np.frombuffer(b"".join(part.column("code").to_pylist()), dtype="<i8").reshape(part.num_rows, -1)
        near = np.frombuffer(b"".join(part.column("near").to_pylist()), dtype="<f8").reshape(part.num_rows, pairs, 2)
        yield part.column("id"), m, near


def with_pivots(rows: DataFrame, pairs) -> DataFrame:
    """id, code (the vector as bytes), near (its pivot distances as bytes)."""
    def measure(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                m = part.column("v").flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(part.num_rows, -1)
                near = _pivot_distances(m, pairs)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([r.tobytes() for r in m], pa.binary()),
                                                  pa.array([r.tobytes() for r in near], pa.binary())], names=["id", "code", "near"])
    return rows.mapInArrow(measure, "id long, code binary, near binary")


def members(staged: DataFrame, centroids: list[list[int]], pairs) -> tuple[dict[int, int], dict[int, list[int]], int]:
    """Members and componentwise sums of every cluster, and the distances measured."""
    points, dims = np.array(centroids, dtype=np.int64), len(centroids[0])

    def total(batches):
        count, sums, measured = np.zeros(len(points), dtype=np.int64), np.zeros((len(points), dims), dtype=object), 0
        for batch in batches:
            for _, m, near in _batches(batch, len(pairs)):
                cluster, _, n = nearest(m, near, points, pairs)
                measured += n
                for c in np.unique(cluster):
                    own = m[cluster == c]
                    count[c] += len(own)
                    # halves of 32 bits, so that sums of a batch fit a long
                    sums[c] += (own >> 32).sum(axis=0).astype(object) * 2 ** 32 + (own & 0xFFFFFFFF).sum(axis=0).astype(object)
        held = [c for c in range(len(points)) if count[c]]
        out = [(c, d, int(v)) for c in held for d, v in [(-1, count[c]), *enumerate(sums[c])]] + [(-1, -1, measured)]
        kinds = (pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([str(v) if k == 2 else v for v in col], t) for k, (col, t) in enumerate(zip(zip(*out), kinds))],
                                         names=["cluster", "dim", "part"])

    parts = staged.mapInArrow(total, "cluster int, dim int, part string")
    # clusters x (dims + 1) rows and one more
    got = {(r["cluster"], r["dim"]): int(r["total"]) for r in parts.groupBy("cluster", "dim").agg(
        F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()}
    counts = {c: n for (c, d), n in got.items() if d == -1 and c >= 0}
    return counts, {c: [got[c, d] for d in range(dims)] for c in counts}, got.get((-1, -1), 0)


def assigned(staged: DataFrame, centroids: list[list[int]], pairs) -> DataFrame:
    """id, cluster, distance (as a decimal) of every row."""
    points = np.array(centroids, dtype=np.int64)

    def assign(batches):
        for batch in batches:
            for ids, m, near in _batches(batch, len(pairs)):
                cluster, distance, _ = nearest(m, near, points, pairs)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array([str(d) for d in distance], pa.string())],
                                                 names=["id", "cluster", "distance"])
    return staged.mapInArrow(assign, "id long, cluster int, distance string").withColumn("distance", F.col("distance").cast("decimal(38,0)"))


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(table: DataFrame, id_: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
            dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per vector that takes part: its id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    rows = integers(table, id_, vector, dims, scale)
    start = first_rows(rows, max(k, 2 * PAIRS), seed)
    if not start:
        return table.sparkSession.createDataFrame(
            [], f"`{id_}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    pairs, centroids = pivot_pairs(start[:2 * PAIRS]), start[:k]
    staged = stage(with_pivots(rows, pairs))
    for _ in range(rounds):
        counts, sums, _ = members(staged, centroids, pairs)
        moved = [[s // counts[c] for s in sums[c]] if c in counts else old for c, old in enumerate(centroids)]
        if moved == centroids:
            break  # further rounds change nothing
        centroids = moved
    last = stage(assigned(staged, centroids, pairs))
    inertia = {r["cluster"]: int(r["total"]) for r in last.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}

    def long(n: int):
        return F.lit(n if n < 2 ** 63 else None).cast("long")

    own = F.array(*[F.struct(long(inertia.get(c, 0)).alias("inertia"), F.lit(digest(v)).alias("sha")) for c, v in enumerate(centroids)])
    fits = F.expr("try_cast(distance AS bigint)")
    return last.select(F.col("id").alias(id_), "cluster", fits.alias("distance"), F.get(own, F.col("cluster"))["inertia"].alias("cluster_inertia"),
                       long(sum(inertia.values())).alias("inertia"), F.get(own, F.col("cluster"))["sha"].alias("centroid_sha256"))
