"""Near copies among embeddings: links found by NN-descent, kept from a cosine threshold on.

Equal vectors are one node. The graph of near neighbours proposes links, which are verified in double precision. A list
that is full of links says nothing about those beyond it. Such saturated lists are enlarged and refined again, these nodes
only: new places go to vectors of other components, and double until no list is saturated. Then the members of each component
are compared in pairs of blocks, each block at most ``BLOCK`` vectors; only sums per vector leave a block. An audit compares a
sample of all, and one of the linked and full, with all vectors, node by node; below ``RECALL`` the lists are searched again in
other orders, and at last all vectors are compared in blocks.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing and are their own
component; so are vectors whose length isn't the table's; a repeated id counts as one vector and each of its rows gets
the result; a null id links with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import stage
from . import neighbours
from .components import components

THRESHOLD = 0.9
K, BLOCK = 16, 512
#: Vectors compared with all others, the recall they have to reach, and further searches if they don't.
AUDIT, RECALL, FURTHER = 256, 0.999, 3
#: By how much a cosine between codes may be below the exact one.
SLACK = 0.05


def cosine(a: str, b: str) -> Column:
    """Of two unit vectors, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _verified(lists: DataFrame, units: DataFrame, scale: float, threshold: float) -> DataFrame:
    """a, b of the pairs in ``lists`` whose cosine reaches the threshold."""
    pairs = lists.select(F.col("id").alias("x"), F.explode("near").alias("n")).where(F.col("n.d") <= _near(scale, threshold))
    pairs = pairs.select(F.least("x", "n.id").alias("a"), F.greatest("x", "n.id").alias("b")).distinct()
    pairs = pairs.join(units.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(units.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    return pairs.where(cosine("va", "vb") >= threshold).select("a", "b")


def _near(scale: float, threshold: float) -> float:
    """The squared distance of codes up to which a pair may reach the threshold."""
    return (2 - 2 * (threshold - SLACK)) * scale * scale


def _blockwise(work: DataFrame, key: list[str], each, schema: str, laid: bool = False) -> DataFrame:
    """``each`` of every run of rows that share ``key`` and hold ``v`` or ``code``: (columns by name, matrix) to a list of columns.

    ``laid``: the rows lie side by side already.
    """
    if not laid:
        work = work.repartition(*key).sortWithinPartitions(*key, "id")
    names = [part.split()[0] for part in schema.split(", ")]
    plain = [c for c in work.columns if c not in ("v", "code")]

    def vectors(rows):
        if "code" in rows.column_names:
            return neighbours._matrix(rows.column("code").to_pylist())
        return rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)

    def units(rows):
        c = {k: rows.column(k).to_numpy() for k in plain}
        matrix = vectors(rows)
        new = np.any([c[k][1:] != c[k][:-1] for k in key], axis=0)
        edges = np.concatenate(([0], np.flatnonzero(new) + 1, [len(rows)]))
        for a, b in zip(edges, edges[1:]):
            out = each({k: x[a:b] for k, x in c.items()}, matrix[a:b])
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=names)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            c = [rows.column(k).to_numpy() for k in key]
            whole = np.flatnonzero(np.any([x != x[-1] for x in c], axis=0))  # the last unit may go on
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield from units(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and len(held):
            yield from units(held)

    return work.mapInArrow(run, schema)


def _dealt(groups: DataFrame, block: int) -> DataFrame:
    """component, low, high, own, id: every pair of blocks of a component with the members of both."""
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    members = groups.join(sizes, "component").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return members.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id")


def _once(c: dict) -> np.ndarray:
    """The pairs that a unit has to compare: within a block once, of two blocks only across."""
    return (c["own"][:, None] != c["own"][None]) if c["low"][0] != c["high"][0] else ~np.eye(len(c["own"]), dtype=bool)


def _forest(alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever ``alike`` (symmetric) connects, one fewer than nodes."""
    left, a, b = alike.any(1), [], []
    while left.any():
        front = [int(left.argmax())]
        left[front] = False
        while front:
            node = front.pop()
            found = np.flatnonzero(alike[node] & left)
            left[found] = False
            a += [node] * len(found)
            b += found.tolist()
            front += found.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def counted(units: DataFrame, groups: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """id, links, nodes: the vectors (copies counted) and the nodes that each node of a component links with.

    ``units``: id, v (unit vector), copies; ``groups``: id, component.
    """
    def sums(c, matrix):
        alike = (matrix @ matrix.T >= threshold) & _once(c)
        links, nodes = alike @ c["copies"], alike.sum(1)
        some = np.flatnonzero(nodes)
        return c["id"][some], links[some], nodes[some]

    work = _dealt(groups, block).join(units.select("id", "v", "copies"), "id")
    found = _blockwise(work, ["component", "low", "high"], sums, "id long, links long, nodes long")
    return found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("nodes").alias("nodes"))


def everywhere(units: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect all that is alike, by comparing all nodes in pairs of blocks."""
    def links(c, matrix):
        a, b = _forest((matrix @ matrix.T >= threshold) & _once(c))
        return c["id"][a], c["id"][b]

    work = _dealt(units.select("id", F.lit(0).cast("long").alias("component")), block).join(units.select("id", "v"), "id")
    return _blockwise(work, ["low", "high"], links, "a long, b long")


def full(lists: DataFrame, scale: float, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """id of the lists that end within the threshold: more may lie beyond."""
    return lists.where((F.size("near") >= k) & (F.element_at("near", -1)["d"] <= _near(scale, threshold))).select("id")


def _apart(c: dict, matrix: np.ndarray, k: int, below: np.ndarray | None = None):
    """The ids that have any, and lists of their ``k`` nearest in other components."""
    if len(matrix) < 2:
        return np.zeros(0, np.int64), []
    far = neighbours._distances(matrix, matrix)
    far[c["component"][:, None] == c["component"]] = np.inf
    some, lists = neighbours._flat_lists(c["id"], far, k, below)
    return c["id"][some], lists


def _side_by_side(nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """``nodes`` in several orders, t, each cut into blocks of vectors on one side of random hyperplanes."""
    bits = max(int(np.ceil(np.log2(max(n / neighbours.LEAF, 1)))), 0)

    def keys(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = neighbours._matrix(batch.column("code").to_pylist())
            planes = np.random.default_rng(seed).standard_normal((m.shape[1], neighbours.TABLES * (bits + 1)))
            sides = (m @ planes).reshape(len(m), neighbours.TABLES, bits + 1)
            side = (sides[:, :, :bits] > 0) @ (2.0 ** np.arange(bits))
            key = side + 1 / (1 + np.exp(-sides[:, :, bits] / 127))  # within a side, in the order of one more projection
            for t in range(neighbours.TABLES):
                own = [pa.array(np.full(len(m), t)), pa.array(key[:, t])]
                yield pa.RecordBatch.from_arrays(own + [batch.column(x) for x in ("component", "id", "code")], names=["t", "key", "component", "id", "code"])

    rows = nodes.select("component", "id", "code").mapInArrow(keys, "t long, key double, component long, id long, code binary")
    rows = rows.repartitionByRange("t", "key").sortWithinPartitions("t", "key", "id")
    return rows.withColumn("block", F.floor(F.monotonically_increasing_id() / neighbours.LEAF))  # a partition's rows are numbered in order


def beyond(codes: DataFrame, lists: DataFrame, groups: DataFrame, ends: DataFrame, k: int, seed: int = neighbours.SEED) -> DataFrame:
    """id, near: ``k`` more places in the lists of ``ends`` (id), for the nearest outside the node's own component.

    Neighbours of neighbours meet as in NN-descent, through the places a list had and the new ones; a node of the own
    component takes no new place, as components are compared whole.
    """
    nodes = stage(ends.join(codes, "id").join(groups, "id", "left").select("id", "code", F.coalesce("component", "id").alias("component")))
    blocks = _blockwise(_side_by_side(nodes, nodes.count(), seed), ["t", "block"], lambda c, m: _apart(c, m, k), f"id long, near {neighbours.LIST}", laid=True)
    more = stage(neighbours._merged(blocks, k))
    for _ in range(neighbours.ROUNDS):
        far = F.when(F.size("near") < k, F.lit(3e38)).otherwise(F.element_at("near", -1)["d"]).cast("float")
        pairs = lists.join(ends, "id", "left_semi").unionByName(more).select("id", F.explode("near.id").alias("other"))
        some = Window.partitionBy("hub").orderBy(F.xxhash64("member", "hub"))
        back = pairs.select(F.col("other").alias("hub"), F.col("id").alias("member")).withColumn("nth", F.row_number().over(some)).where(F.col("nth") <= k).drop("nth")
        members = pairs.select(F.col("id").alias("hub"), F.col("other").alias("member")).unionByName(back).distinct()
        known = nodes.join(more.select("id", far.alias("far")), "id", "left").withColumn("far", F.coalesce("far", F.lit(3e38).cast("float")))
        meeting = members.join(known.withColumnRenamed("id", "member"), "member").select("hub", F.col("member").alias("id"), "component", "far", "code")
        met = _blockwise(meeting, ["hub"], lambda c, m: _apart(c, m, k, c["far"]), f"id long, near {neighbours.LIST}")
        more = stage(neighbours._merged(met.unionByName(more.select("id", F.col("near").cast(neighbours.LIST).alias("near"))), k))
    return more


def enlarged(units: DataFrame, codes: DataFrame, lists: DataFrame, edges: DataFrame, scale: float, threshold: float, seed: int) -> DataFrame:
    """component of each linked id, once the lists that ended within the threshold have had room for all beyond.

    Saturated lists get ``K`` more places, then twice as many in each round, until none is saturated or what fills the
    places links with nothing. Every round that goes on joins components, so rounds come to an end.
    """
    k, groups = K, stage(components(edges))
    ends = stage(full(lists, scale, threshold))
    while not ends.isEmpty():
        more = beyond(codes, lists, groups, ends, k, seed)
        found = stage(_verified(more, units, scale, threshold))
        if found.isEmpty():
            break
        edges = stage(edges.unionByName(found))
        groups = stage(components(edges))
        ends, k, seed = stage(full(more, scale, threshold, k)), 2 * k, seed + 1
    return groups


def recall(units: DataFrame, found: DataFrame, threshold: float = THRESHOLD, sample: int = AUDIT, among: DataFrame | None = None) -> float:
    """Part of a node's links that ``found`` has, on average over those of the ``sample`` nodes (of ``among``, if given) that have links.

    The nodes whose ids hash lowest are asked. A node counts as one, however many links it has.
    """
    asked = units if among is None else units.join(among, "id", "left_semi")
    some = [(r["id"], list(r["v"])) for r in asked.orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    if not some:
        return 1.0
    names, matrix = np.array([i for i, _ in some]), np.array([v for _, v in some])

    def count(batches):
        n = np.zeros(len(names), np.int64)
        for batch in batches:
            if batch.num_rows:
                m = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                n += ((m @ matrix.T >= threshold) & (batch.column("id").to_numpy()[:, None] != names)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], names=["id", "n"])

    true = units.select("id", "v").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    part = true.where("n > 0").join(found, "id", "left").agg(F.avg(F.least(F.coalesce("nodes", F.lit(0)) / F.col("n"), F.lit(1.0)))).first()[0]
    return 1.0 if part is None else part


def near_copies(table: DataFrame, id_: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept."""
    rows = stage(neighbours.vectors(table, id_, vector))
    nodes = neighbours.classes(rows)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    units = stage(nodes.withColumn("norm", norm).select("id", F.col("v").alias("original"), F.transform("v", lambda x: x / F.col("norm")).alias("v"), "copies"))
    scale = neighbours.scale(units)
    codes = stage(neighbours.coded(units, scale))
    n = units.count()
    lists = neighbours.graph(codes, n, K)
    for further in range(FURTHER + 1):
        edges = stage(_verified(lists, units, scale, threshold))
        groups = enlarged(units, codes, lists, edges, scale, threshold, neighbours.SEED + further)
        found = stage(counted(units, groups, threshold))
        some = full(lists, scale, threshold).unionByName(found.select("id")).distinct()
        if min(recall(units, found, threshold), recall(units, found, threshold, among=some)) >= RECALL:
            break
        if further == FURTHER:
            groups = stage(components(stage(everywhere(units, threshold))))
            found = stage(counted(units, groups, threshold))
            break
        more = neighbours.tables(codes, n, K, seed=neighbours.SEED + 1 + further)
        both = lists.unionByName(more.select("id", F.col("near").cast(neighbours.LIST).alias("near")))
        lists = stage(neighbours.refined(codes, stage(neighbours._merged(both, K)), K))
    # every vector has its node's links, and its copies
    about = units.join(groups, "id", "left").join(found, "id", "left").select(
        F.col("original").alias("v"), F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    mine = rows.join(about, "v").select(F.col("id").alias("__id"), "component_id", "n_links")
    out = table.select(F.col(id_).cast("long").alias("vec_id")).join(mine, F.col("vec_id") == F.col("__id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
