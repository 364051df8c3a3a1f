"""Near copies by the Jaccard similarity of word shingles, exactly: rare-first prefix filtering.

A document is the set of its hashed shingles, in one order for all documents: rare shingles first. The frequencies come
from a fixed table of counters summed over every document, so the order is the same everywhere whatever the table holds,
and results don't depend on it. Two sets with similarity t share a shingle among their first n - ceil(t n) + 1, so only
those prefixes are joined. Lengths are compared in bands: similar sets fall into one band or the next. A shingle counts
in a band only if its place in the set still leaves room for the overlap needed with the smallest set there.

The documents of one shingle and band meet at their smallest member, the leader: pairs aren't emitted. A leader's
neighbourhood holds every pair that its shingles propose; it is verified in blocks of at most ``BLOCK`` documents, each
pair of different local groups once, after a suffix filter (a histogram of hashes bounds how many shingles differ). What
leaves a block is a spanning forest of its links; components join them.

Defined cases: null and empty texts, and texts without words, are empty sets and link with nothing; fewer words than a
shingle has are one shingle; copies of one set count as one node; repeated doc_ids are each compared, and a null doc_id
never is the smallest unless alone; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import stage
from .components import components
from .hashing import mixed, prefix, spans

WORDS = 5
#: Similarity as a fraction.
OVER, UNDER = 75, 100
#: Counters of shingle frequencies, in slices that are summed apart.
COUNTERS, SLICES = 1 << 20, 64
#: Documents that one task compares with one another.
BLOCK = 1024
#: Buckets of the histogram that bounds the difference of two sets.
HISTOGRAM = 256

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words."""
    raw = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    edges = np.diff(np.concatenate(([0], (~_SPACE[raw]).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    word = mixed(spans(prefix(raw), starts, ends) + (ends - starts).astype(np.uint64))
    n = max(len(word) - words + 1, 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(min(words, len(word))):
        rolled = rolled * np.uint64(0xC2B2AE3D27D4EB4F) + word[k:k + n]
    return np.unique(mixed(rolled + np.uint64(min(words, len(word)))))


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def node(hashes: np.ndarray) -> int:
    """A set's own hash: one number per set, whatever document holds it."""
    total = np.array([len(hashes)], dtype=np.uint64) + mixed(hashes, 0x9FB21C651E98DF25).sum(dtype=np.uint64)
    return int(mixed(total).view(np.int64)[0])


def frequencies(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Counts of shingles by cell over all documents: ``COUNTERS`` numbers, always."""
    def count(batches):
        cells = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(cells, _cell(shingles(text, words)), 1)
        for i, part in enumerate(np.split(cells.astype("<i4"), SLICES)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "counts"])

    def add(key, group):
        parts = [np.frombuffer(c, dtype="<i4" if len(c) == 4 * COUNTERS // SLICES else "<i8").astype(np.int64) for c in group.column("counts").to_pylist()]
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([sum(parts).astype("<i8").tobytes()], pa.binary())})

    schema = "slice int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).collect()  # SLICES rows
    out = np.zeros(COUNTERS, dtype=np.int64)
    for r in rows:
        width = COUNTERS // SLICES
        out[r["slice"] * width:(r["slice"] + 1) * width] = np.frombuffer(r["counts"], dtype="<i8")
    return out


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n (set size), node (null for an empty set)."""
    def run(batches):
        for batch in batches:
            own = [shingles(text, words) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(o) for o in own], pa.int64()), pa.array([node(o) if len(o) else None for o in own], pa.int64())], names=["doc_id", "n", "node"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long")


def prefixes(docs: DataFrame, counts: np.ndarray, words: int = WORDS, over: int = OVER, under: int = UNDER) -> DataFrame:
    """token, node, n, place: the rare ends of the sets. A task gives each set once, however many documents hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers

    def run(batches):
        seen = set()
        for batch in batches:
            tokens, nodes, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text, words)
                name = node(own) if len(own) else None
                if name is None or name in seen:
                    continue
                seen.add(name)
                take = len(own) - -(-len(own) * over // under) + 1
                tokens.append(own[np.lexsort((own, shared.value[_cell(own)]))[:take]].view(np.int64))
                nodes.append(name)
                sizes.append(len(own))
            if tokens:
                taken = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.array(nodes), taken)), pa.array(np.repeat(sizes, taken).astype(np.int32)),
                                                  pa.array(np.concatenate([np.arange(t) for t in taken]).astype(np.int32))], names=["token", "node", "n", "place"])

    return docs.select("text").mapInArrow(run, "token long, node long, n int, place int")


def stars(rows: DataFrame, over: int = OVER, under: int = UNDER) -> DataFrame:
    """leader, band, node: who has to be compared around whom; a leader is among its own nodes. ``rows``: ``prefixes``."""
    alike = Window.partitionBy("token")
    rows = rows.withColumns({"low": F.min("node").over(alike), "high": F.max("node").over(alike)}).where("low <> high")
    # sets in one band or the next can be similar: every set enters its band and the one below
    band = F.floor(F.log("n") / F.lit(float(np.log(under / over))) + 1e-9)
    banded = rows.select("token", "node", "n", "place", F.explode(F.array(band, band - 1)).alias("band"))
    group = Window.partitionBy("token", "band")
    banded = banded.withColumn("small", F.min("n").over(group))
    room = (F.col("n") - F.col("place")) * (under + over) >= F.lit(over) * (F.col("n") + F.col("small"))
    banded = banded.where(room).withColumns({"leader": F.min("node").over(group), "high": F.max("node").over(group)})
    return banded.where("leader <> high").select("leader", "band", "node").distinct()


def _similar(a: np.ndarray, b: np.ndarray, over: int, under: int) -> bool:
    both = np.searchsorted(a, b)
    common = int((a[np.minimum(both, len(a) - 1)] == b).sum())
    return under * common >= over * (len(a) + len(b) - common)


def linked(own: list[np.ndarray], over: int = OVER, under: int = UNDER) -> np.ndarray:
    """Local group of every set: the smallest index that links reach."""
    m = len(own)
    group = np.arange(m)
    size = np.array([len(s) for s in own])

    def join(i, j):
        a, b = group[i], group[j]
        if a != b:
            group[group == max(a, b)] = min(a, b)

    # everybody against one set at once
    where = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(own)
    at = np.searchsorted(own[0], flat)
    common = np.add.reduceat((own[0][np.minimum(at, size[0] - 1)] == flat).astype(np.int64), where[:-1])
    group[under * common >= over * (size + size[0] - common)] = 0
    if m <= 2 or not group.any():
        return group
    histogram = np.zeros((m, HISTOGRAM), dtype=np.int16)
    np.add.at(histogram, (np.repeat(np.arange(m), size), (flat & np.uint64(HISTOGRAM - 1)).astype(np.int64)), 1)
    for i in range(m - 1):
        j = np.arange(max(i + 1, 1), m)
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        j = j[(group[j] != group[i]) & (under * small >= over * large)]
        if not len(j):
            continue
        # similar sets differ in at most this many shingles
        differ = (size[i] + size[j]) * (under - over) // (under + over)
        for k in j[np.abs(histogram[j] - histogram[i]).sum(1) <= differ]:
            if group[k] != group[i] and _similar(own[i], own[k], over, under):
                join(i, k)
    return group


def links(docs: DataFrame, found: DataFrame, counts: np.ndarray, words: int = WORDS, over: int = OVER, under: int = UNDER) -> DataFrame:
    """a, b: links between nodes that span every group of similar sets. ``docs``: doc_id, text; ``found``: ``sets``."""
    around = stage(stars(prefixes(docs, counts, words, over, under), over, under))
    crowds = around.groupBy("leader", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    # every block of a neighbourhood meets every other
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    units = around.join(crowds, ["leader", "band"]).withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = units.select("leader", "band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node")
    # one document stands for a node, and its text moves once to be joined and once to its units
    wanted = around.select("node").distinct()
    chosen = found.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    key = ["leader", "band", "low", "high"]
    work = units.join(chosen, "node").join(docs, "doc_id").select(*key, "node", "text")
    if not found.where("doc_id IS NULL AND node IS NOT NULL").isEmpty():
        # sets that only rows without an id hold are found by their node
        nameless = with_node(docs.where("doc_id IS NULL"), words).join(chosen.where("doc_id IS NULL").select("node"), "node")
        work = work.unionByName(units.join(nameless.groupBy("node").agg(F.min("text").alias("text")), "node").select(*key, "node", "text"))
    work = work.repartition(*key).sortWithinPartitions(*key, "node")

    def groups(batches):
        held, last = {}, None
        for batch in batches:
            ids = list(zip(*(batch.column(c).to_pylist() for c in (*key, "node"))))
            for (*unit, name), text in zip(ids, batch.column("text").to_pylist()):
                if unit != last and held:
                    yield held
                    held = {}
                last = unit
                own = shingles(text, words)
                if name not in held and len(own) and node(own) == name:  # another row may carry the same doc_id
                    held[name] = own
        if held:
            yield held

    def verify(batches):
        a, b = [], []
        for held in groups(batches):
            if len(held) < 2:
                continue
            names = np.array(list(held))
            group = linked(list(held.values()), over, under)
            other = group != np.arange(len(group))
            a += names[other].tolist()
            b += names[group[other]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return work.mapInArrow(verify, "a long, b long")


def with_node(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with ``node``, the hash of each text's set; null without words."""
    def of(texts: pd.Series) -> pd.Series:
        held = (shingles(t, words) for t in texts)
        return pd.Series([node(h) if len(h) else None for h in held], index=texts.index, dtype="Int64")
    return docs.withColumn("node", F.pandas_udf(of, "long")(F.col("text")))


def grouped(docs: DataFrame, words: int = WORDS, over: int = OVER, under: int = UNDER) -> DataFrame:
    """One row per document: doc_id, n, node, component_id (null without words), and ``first``, the node that stands for the
    component: the smallest one of its smallest doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stage(sets(docs, words))
    together = components(links(docs, found, frequencies(docs, words), words, over, under))
    # copies of a set, and then the sets of a component, by their smallest document; documents without an id come last
    nodes = found.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = stage(nodes.join(together, nodes["node"] == together["id"], "left").select("node", "first", F.coalesce("component", "node").alias("component")))
    smallest = named.groupBy("component").agg(F.min(F.struct(F.col("first").isNull().alias("nameless"), "first", "node")).alias("s"))
    final = named.join(smallest, "component").select("node", F.col("s.first").alias("component_id"), F.col("s.node").alias("first"))
    return found.select("doc_id", "n", "node").join(final, "node", "left")


def near_copies(docs: DataFrame, words: int = WORDS, over: int = OVER, under: int = UNDER) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included)."""
    out = grouped(docs, words, over, under)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def kept(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each component the document with the smallest id stays.

    Rows that repeat doc_id and text are one document, and one of them stays. Rows that share the doc_id alone are documents
    of their own: each goes only if its own text is a copy. Documents without words, and those without an id, all stay.
    """
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        gone = near_copies(docs).where("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    named = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    docs = named.unionByName(docs.where("doc_id IS NULL"))
    copies = grouped(docs).where("doc_id IS NOT NULL AND (doc_id <> component_id OR node <> first)")
    gone = stage(copies.select("doc_id", "node").distinct())
    ids = gone.select("doc_id").distinct()
    suspects = with_node(docs.join(ids, "doc_id", "left_semi")) if "node" not in docs.columns else with_node(
        docs.join(ids, "doc_id", "left_semi").withColumnRenamed("node", "__node"))
    left = suspects.join(gone, ["doc_id", "node"], "left_anti").drop("node").withColumnRenamed("__node", "node")
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns).unionByName(left.select(*docs.columns))
