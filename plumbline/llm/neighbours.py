"""NN-descent: a graph of near neighbours, refined by joining the neighbours of neighbours.

Lists start from blocks of rows that lie side by side in the order of a few random hyperplanes (range-partitioned, so a
crowd of alike vectors is cut into blocks like everything else). In a round every vector is a hub: the vectors it lists
and those that list it meet there, with their vectors, and learn of one another what improves their lists. Lists hold the
``k`` nearest found. Vectors travel as bytes of a common scale, or as floats where lengths differ too much for one scale;
whoever needs exact distances takes the originals again.

The graph is approximate by nature: a hub takes at most ``k`` of those that list it. Callers audit its recall.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import stage

K, TABLES, LEAF, ROUNDS = 20, 8, 256, 2
SEED = 7
LIST = "array<struct<d:float,id:bigint>>"


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def _pack(frame: DataFrame, fn, keep: tuple[str, ...], schema: str) -> DataFrame:
    """Rows with ``v`` (array<double>) through ``fn``, which makes a matrix into a list of values."""
    def run(batches):
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            matrix = flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            extra = fn(matrix)
            columns = [batch.column(c) for c in keep] + [pa.array(x, t) for x, t in extra]
            names = list(keep) + [part.split()[0] for part in schema.split(", ")[len(keep):]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return frame.select(*keep, "v").mapInArrow(run, schema)


def scale(vectors: DataFrame) -> float:
    """Code units per unit of ``v``."""
    return 127.0 / (vectors.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 127.0)


def coded(vectors: DataFrame, units: float, kind: type = np.int8) -> DataFrame:
    """id, code (a byte, or a value of another ``kind``, per component) of ``vectors`` (id long, v array<double>)."""
    def codes(m):
        scaled = np.rint(m * units) if kind is np.int8 else m * units
        return [([r.tobytes() for r in scaled.astype(kind)], pa.binary())]

    return _pack(vectors, codes, ("id",), "id long, code binary")


def vectors(table: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v (array<double>) of the usable vectors that have an id, one row per id (the smallest vector of a repeated one).

    Where lengths differ, the most frequent one (the smaller of two) counts.
    """
    rows = table.where(usable(F.col(vector)) & F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    one = rows.groupBy("id").agg(F.min("v").alias("v"))
    sizes = one.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return one.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def classes(rows: DataFrame) -> DataFrame:
    """id (the smallest of equal vectors), v, copies."""
    return rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "v", "copies")


def _matrix(codes: list[bytes], kind: type = np.int8) -> np.ndarray:
    return np.frombuffer(b"".join(codes), dtype=kind).reshape(len(codes), -1).astype(np.float32 if kind is np.int8 else np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, in units of the code's scale."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def _flat_lists(ids: np.ndarray, distances: np.ndarray, k: int, below: np.ndarray | None = None):
    """(rows that have any, their nearest ``k`` others as Arrow lists); with ``below`` only those nearer than that."""
    n = len(ids)
    np.fill_diagonal(distances, np.inf)
    take = min(k, n - 1)
    best = np.argpartition(distances, take - 1, axis=1)[:, :take]
    near = np.take_along_axis(distances, best, 1)
    some = near < (np.full(n, np.float32(3e38)) if below is None else below)[:, None]
    sizes = some.sum(1)
    rows = np.flatnonzero(sizes)
    structs = pa.StructArray.from_arrays([pa.array(near[some].astype(np.float32)), pa.array(ids[best[some]])], names=["d", "id"])
    return rows, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes[rows]))).astype(np.int32)), structs)


def _merged(rows: DataFrame, k: int) -> DataFrame:
    """id, near: the ``k`` nearest over all lists of an id, nearest first."""
    # a list holds at most k entries, and an id has a list per table or hub that improved it
    return rows.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))


def tables(codes: DataFrame, n: int, k: int, count: int = TABLES, leaf: int = LEAF, seed: int = SEED, kind: type = np.int8) -> DataFrame:
    """id, near: lists from blocks of ``leaf`` rows in ``count`` orders."""
    bits = max(int(np.ceil(np.log2(max(n / leaf, 1)))), 0)

    def keys(batches):
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column("code").to_pylist(), kind)
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((m.shape[1], count * (bits + 1))).astype(np.float32)
            sides = (m @ planes).reshape(len(m), count, bits + 1)
            bit = (sides[:, :, :bits] > 0) @ (2.0 ** np.arange(bits)) if bits else np.zeros((len(m), count))
            # within a side of all planes, in the order of one more projection
            key = bit + 1 / (1 + np.exp(-sides[:, :, bits] / (np.abs(sides[:, :, bits]).mean() + 1e-9)))
            for t in range(count):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, np.int32)), pa.array(key[:, t].astype(float)), batch.column("id"), batch.column("code")], names=["t", "key", "id", "code"])

    def near(batches):
        held: list = []
        size = 0

        def blocks(rows, all_):
            whole = len(rows) if all_ else len(rows) // leaf * leaf
            t = rows.column("t").to_numpy()
            ids = rows.column("id").to_numpy()
            codes_ = rows.column("code").to_pylist()
            edges = sorted({*range(0, whole, leaf), *(np.flatnonzero(t[1:whole] != t[:whole - 1]) + 1).tolist(), whole})
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    m = _matrix(codes_[a:b], kind)
                    some, lists = _flat_lists(ids[a:b], _distances(m, m), k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][some]), lists], names=["id", "near"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 16 * leaf:
                rows = pa.Table.from_batches(held)
                yield from blocks(rows, False)
                rest = rows.slice(len(rows) // leaf * leaf).combine_chunks()
                held, size = rest.to_batches(), len(rest)
        if size > 1:
            yield from blocks(pa.Table.from_batches(held), True)

    spread = codes.mapInArrow(keys, "t int, key double, id long, code binary").repartitionByRange("t", "key").sortWithinPartitions("t", "key")
    return _merged(spread.mapInArrow(near, f"id long, near {LIST}"), k)


def refined(codes: DataFrame, lists: DataFrame, k: int, kind: type = np.int8) -> DataFrame:
    """One round: ``lists`` with what neighbours of neighbours improve."""
    far = F.when(F.size("near") < k, F.lit(3e38)).otherwise(F.element_at("near", -1)["d"]).cast("float")
    pairs = lists.select("id", F.explode("near.id").alias("other"))
    # those that list a hub, at most k of them (the choice differs from round to round with the lists)
    some = Window.partitionBy("hub").orderBy(F.xxhash64("member", "hub"))
    back = pairs.select(F.col("other").alias("hub"), F.col("id").alias("member")).withColumn("nth", F.row_number().over(some)).where(F.col("nth") <= k).drop("nth")
    members = pairs.select(F.col("id").alias("hub"), F.col("other").alias("member")).unionByName(back).distinct()
    known = codes.join(lists.select("id", far.alias("far")), "id", "left").select(F.col("id").alias("member"), "code", F.coalesce("far", F.lit(3e38).cast("float")).alias("far"))
    meeting = members.join(known, "member").select("hub", "member", "code", "far").repartition("hub").sortWithinPartitions("hub")

    def meet(batches):
        carried = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if carried is None else pa.concat_tables([carried, pa.Table.from_batches([batch])])
            hub = rows.column("hub").to_numpy()
            last = int(np.flatnonzero(hub != hub[-1])[-1]) + 1 if len(hub) and (hub != hub[-1]).any() else 0
            carried = rows.slice(last)
            if last:
                yield from local(rows.slice(0, last))
        if carried is not None and len(carried):
            yield from local(carried)

    def local(rows):
        hub, ids, far_ = (rows.column(c).to_numpy() for c in ("hub", "member", "far"))
        codes_ = rows.column("code").to_pylist()
        edges = np.concatenate(([0], np.flatnonzero(hub[1:] != hub[:-1]) + 1, [len(hub)]))
        who, lists_ = [], []
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                m = _matrix(codes_[a:b], kind)
                some, found = _flat_lists(ids[a:b], _distances(m, m), k, far_[a:b])
                who.append(ids[a:b][some])
                lists_.append(found)
        if who:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), pa.concat_arrays(lists_)], names=["id", "near"])

    found = meeting.mapInArrow(meet, f"id long, near {LIST}")
    return _merged(found.unionByName(lists.select("id", F.col("near").cast(LIST).alias("near"))), k)


def graph(codes: DataFrame, n: int, k: int = K, rounds: int = ROUNDS, count: int = TABLES, seed: int = SEED, kind: type = np.int8) -> DataFrame:
    """id, near (at most ``k`` structs of d and id, nearest first; d is squared and in the code's scale)."""
    lists = stage(tables(codes, n, k, count, seed=seed, kind=kind))
    for _ in range(rounds):
        lists = stage(refined(codes, lists, k, kind))
    return lists
