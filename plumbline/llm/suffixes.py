"""Removal of repeated passages: sparse suffix sorting with hashed comparisons.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier. Suffixes are taken at anchors: the smallest hash
of ``GRAM`` bytes in every window of ``LENGTH`` bytes, so two equal strings have an anchor at the same place, and about
every thirtieth byte is one. An anchor's surroundings hold every string through it. Three steps decide them:

1. Anchors with one gram meet. One whose surroundings all stand earlier is repeated as a whole; one whose gram stands
   nowhere else, or only in the same surroundings later, is not. Only hashes travel.
2. The rest, edges of repeated passages, send their surroundings. Within a gram, the suffixes from the anchors are sorted
   by mergesort, and so are the reversed prefixes before them; two of them are compared by the length of their common
   extension, which is found by binary search on polynomial prefix hashes, and the byte after it. Neighbours in the
   sorted order are verified byte by byte. Two strings through an anchor are equal if their parts before and from the
   anchor are in the same classes of such common extensions.
3. A document's intervals are united and its other bytes kept.

A gram with more than ``CROWD`` distinct surroundings isn't gathered: its strings are compared one by one in a grouping.

Defined cases: null text counts as empty; null doc_ids come first; rows that repeat doc_id and text are one document,
rows that repeat the doc_id alone are ordered by a hash of their text; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import stage
from .hashing import BASE, mixed, prefix, spans
from .shared import written

LENGTH, GRAM = 100, 32
BEFORE = LENGTH - GRAM
#: Distinct surroundings of a gram that one task sorts; beyond them, see above.
CROWD = 50_000
#: Surroundings that are sorted at once, and bytes that are hashed at once.
BATCH, CHUNK = 20_000, 1 << 20


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    out, covered = values, 1
    while covered < width:
        step = min(covered, width - covered)
        out = pick(out[:-step], out[step:])
        covered += step
    return out


def _anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the smallest grams of every window; all of them where several are smallest."""
    width = LENGTH - GRAM + 1
    at = np.arange(len(codes) - GRAM + 1)
    grams = mixed(spans(prefix(codes), at, at + GRAM))
    low = _sliding(grams, width, np.minimum)
    edge = width - 1
    most = _sliding(np.concatenate((np.repeat(low[:1], edge), low, np.repeat(low[-1:], edge))), width, np.maximum)
    found = np.flatnonzero(grams == most[:len(grams)])
    return found, grams[found]


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, gram hashes, hashes of the surroundings and their extent)."""
    codes = np.frombuffer(raw, dtype=np.uint8)
    n = len(codes)
    places, grams, around = [], [], []
    for a in range(0, n - LENGTH + 1, CHUNK):
        part = codes[a:a + CHUNK + LENGTH - 1]
        at, gram = _anchors(part)
        # the surroundings may reach beyond the part on either side
        low, high = max(a - BEFORE, 0), min(a + len(part) + LENGTH, n)
        sums = prefix(codes[low:high])
        at = at + a
        start, end = np.maximum(at - BEFORE, 0), np.minimum(at + LENGTH, n)
        own = mixed(spans(sums, start - low, end - low), 0x9FB21C651E98DF25) + mixed(((at - start) * 1024 + (end - at)).astype(np.uint64))
        places.append(at), grams.append(gram), around.append(own)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(grams)[first], np.concatenate(around)[first]


#: Stands for a null doc_id.
NOBODY = -(1 << 63)


def _documents(docs: DataFrame) -> DataFrame:
    """doc, tag (who it is), text. The tag tells texts with one doc_id apart; it is 0 if no doc_id repeats."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY))
    text = F.coalesce("text", F.lit(""))
    repeated = docs.groupBy(doc).count().where("count > 1").limit(1).count()
    return docs.select(doc.alias("doc"), (F.hash(text) if repeated else F.lit(0)).alias("tag"), text.alias("text"))


def _arrow(rows: DataFrame, fn, schema: str, names: tuple[str, ...]) -> DataFrame:
    """``fn`` turns a batch's columns (as lists) into columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = fn(*(part.column(c).to_pylist() for c in names))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in schema.split(", ")])

    return rows.select(*names).mapInArrow(run, schema)


def _grams(docs: DataFrame) -> DataFrame:
    """gram, around, doc, tag, at of all anchors."""
    def of(doc, tag, text):
        found = [anchors(t.encode("utf-8", "surrogatepass")) for t in text]
        sizes = [len(f[0]) for f in found]
        joined = [np.concatenate([f[k] for f in found]) for k in range(3)]
        return joined[1].view(np.int64), joined[2].view(np.int64), np.repeat(np.array(doc, np.int64), sizes), np.repeat(np.array(tag, np.int32), sizes), joined[0].astype(np.int32)

    return _arrow(docs, of, "gram long, around long, doc long, tag int, at int", ("doc", "tag", "text"))


def _decided(grams: DataFrame) -> DataFrame:
    """gram, doc, tag, at, whole: anchors repeated as a whole, and those that have to be compared."""
    rows = grams.repartition("gram")
    alike = Window.partitionBy("gram")
    same = Window.partitionBy("gram", "around").orderBy("doc", "tag", "at")
    before = F.lag(F.struct("doc", "tag", "at")).over(same)
    rows = rows.withColumns({"low": F.min("around").over(alike), "high": F.max("around").over(alike)}).withColumn("before", before)
    # rows that repeat a document repeat its anchors at the same places
    rows = rows.where("before IS NULL OR before <> struct(doc, tag, at)")
    return rows.where("before IS NOT NULL OR low <> high").select("gram", "doc", "tag", "at", F.expr("before IS NOT NULL").alias("whole"))


def _surroundings(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """gram, doc, tag, at, before (bytes ahead of the anchor), bytes."""
    lists = marks.where("size(edges) > 0").select("doc", "tag", F.col("edges.gram").alias("grams"), F.col("edges.at").alias("ats"))
    joined = docs.join(lists, ["doc", "tag"])

    def of(doc, tag, text, grams, ats):
        out = [[] for _ in range(6)]
        for d, g, t, own, places in zip(doc, tag, text, grams, ats):
            raw = t.encode("utf-8", "surrogatepass")
            for gram, at in zip(own, places):
                start = max(at - BEFORE, 0)
                for column, value in zip(out, (gram, d, g, at, at - start, raw[start:at + LENGTH])):
                    column.append(value)
        return out

    return _arrow(joined, of, "gram long, doc long, tag int, at int, before int, bytes binary", ("doc", "tag", "text", "grams", "ats"))


class Suffixes:
    """Rows of bytes, all from one point on, with prefix hashes for comparing them."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray):
        self.rows, self.sizes = rows, sizes
        powers = np.full(rows.shape[1], BASE, dtype=np.uint64)
        powers[:1] = 1
        powers = np.cumprod(powers)
        self.sums = np.zeros((rows.shape[0], rows.shape[1] + 1), dtype=np.uint64)
        np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=self.sums[:, 1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of rows ``a`` and ``b``, by binary search on the hashes."""
        low, high = np.zeros(len(a), dtype=np.int64), np.minimum(self.sizes[a], self.sizes[b])
        for _ in range(int(self.rows.shape[1]).bit_length()):
            middle = (low + high + 1) // 2
            same = self.sums[a, middle] == self.sums[b, middle]
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def less(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Whether ``a`` sorts before ``b``; ``ties``: the answer for equal rows."""
        k = self.common(a, b)
        ends = k >= np.minimum(self.sizes[a], self.sizes[b])
        last = self.rows.shape[1] - 1
        x, y = self.rows[a, np.minimum(k, last)], self.rows[b, np.minimum(k, last)]
        tied = ends & (self.sizes[a] == self.sizes[b])
        return np.where(tied, ties, np.where(ends, self.sizes[a] < self.sizes[b], x < y))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Rows in order within their groups (which are runs of ``group``), by merging runs of doubling length."""
        n = len(group)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, n))
        start, count = np.repeat(first, size), np.repeat(size, size)
        order, width = np.arange(n), 1
        while width < size.max(initial=0):
            live = np.flatnonzero(count > width)
            place = live - start[live]
            pair = place // (2 * width) * 2 * width  # where the two runs begin
            left = place - pair < width
            middle, end = np.minimum(pair + width, count[live]), np.minimum(pair + 2 * width, count[live])
            low = np.where(left, middle, pair) + start[live]
            high = np.where(left, end, middle) + start[live]
            begin, mine = low.copy(), order[live]
            for _ in range(width.bit_length()):
                at = np.flatnonzero(low < high)
                if not len(at):
                    break
                probe = (low[at] + high[at]) // 2
                other = order[probe]
                # of equal rows the left run's come first
                goes = np.where(left[at], self.less(other, mine[at], False), self.less(other, mine[at], True))
                low[at], high[at] = np.where(goes, probe + 1, low[at]), np.where(goes, high[at], probe)
            own = np.where(left, place - pair, place - middle)
            new = order.copy()
            new[start[live] + pair + own + (low - begin)] = mine
            order, width = new, 2 * width
        return order

    def extensions(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Common extension of each row in ``order`` with the one before it, -1 at a group's first; verified on the bytes."""
        a, b = order[1:], order[:-1]
        k = self.common(a, b)
        span = np.arange(self.rows.shape[1])
        if ((self.rows[a] != self.rows[b]) & (span < k[:, None])).any():
            raise ArithmeticError("two different strings share a hash")
        return np.concatenate(([-1], np.where(group[a] == group[b], k, -1)))


def repeats(group: np.ndarray, rows: list[bytes], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) per row: the bytes of it that strings of earlier rows of its group cover; (0, 0) if none.

    Rows come by group, and within it in the documents' order.
    """
    m = len(rows)
    after = np.array([len(r) for r in rows]) - before
    left, right = np.zeros((m, BEFORE), np.uint8), np.zeros((m, LENGTH), np.uint8)
    flat = np.frombuffer(b"".join(rows), dtype=np.uint8)
    ends = np.cumsum(before + after)
    anchor = ends - after
    for k in range(BEFORE):
        has = before > k
        left[has, k] = flat[anchor[has] - 1 - k]
    for k in range(LENGTH):
        has = after > k
        right[has, k] = flat[anchor[has] + k]
    sides = []
    for side, size in ((left, before), (right, after)):
        try:
            suffixes = Suffixes(side, size)
            order = suffixes.sort(group)
            extensions = suffixes.extensions(order, group)
        except ArithmeticError:  # the same order without hashes
            keys = [*(side[:, k].astype(np.int16) * (size > k) - (size <= k) for k in range(side.shape[1] - 1, -1, -1)), group]
            order = np.lexsort(keys)
            differ = (side[order[1:]] != side[order[:-1]]) | (np.arange(side.shape[1]) >= np.minimum(size[order[1:]], size[order[:-1]])[:, None])
            k = np.where(differ.any(1), differ.argmax(1), side.shape[1])
            extensions = np.concatenate(([-1], np.where(group[order[1:]] == group[order[:-1]], k, -1)))
        sides.append((order, extensions))
    first, end = np.full(m, 1 << 30), np.zeros(m, np.int64)
    for k in range(BEFORE + 1):  # strings that begin k bytes ahead of the anchor
        able = np.flatnonzero((before >= k) & (after >= LENGTH - k))
        if len(able) < 2:
            continue
        names = []
        for (order, extensions), depth in zip(sides, (k, LENGTH - k)):
            name = np.empty(m, np.int64)
            name[order] = np.cumsum(extensions < depth)
            names.append(name[able])
        key = names[0] * (m + 1) + names[1]
        by = np.argsort(key, kind="stable")
        again = able[by[1:][key[by[1:]] == key[by[:-1]]]]
        first[again] = np.minimum(first[again], before[again] - k)
        end[again] = np.maximum(end[again], before[again] - k + LENGTH)
    # two strings through one anchor overlap, so their union is an interval
    return np.where(end > 0, first, 0), end


def _sorted_edges(around: DataFrame) -> DataFrame:
    """doc, tag, start, end of what earlier surroundings of the same gram cover."""
    names = ["gram", "doc", "tag", "at", "before", "bytes"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def decide(table):
            gram = table.column("gram").to_numpy()
            group = np.cumsum(np.append(True, gram[1:] != gram[:-1]))
            before = table.column("before").to_numpy().astype(np.int64)
            first, end = repeats(group, table.column("bytes").to_pylist(), before)
            some = np.flatnonzero(end > 0)
            base = table.column("at").to_numpy()[some] - before[some]
            return pa.RecordBatch.from_arrays([pa.array(table.column("doc").to_numpy()[some]), pa.array(table.column("tag").to_numpy()[some]), pa.array((base + first[some]).astype(np.int32)), pa.array((base + end[some]).astype(np.int32))], names=["doc", "tag", "start", "end"])

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            gram = table.column("gram").to_numpy()
            whole = np.flatnonzero(gram != gram[-1])
            if len(whole) and whole[-1] + 1 >= BATCH:  # the last gram may go on
                yield decide(table.slice(0, whole[-1] + 1))
                held = table.slice(whole[-1] + 1).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield decide(table)

    rows = around.select(*names).repartition("gram").sortWithinPartitions("gram", "doc", "tag", "at")
    return rows.mapInArrow(run, "doc long, tag int, start int, end int")


def _crowded_edges(around: DataFrame) -> DataFrame:
    """The same for grams whose surroundings are too many to gather: each string is a row."""
    k = F.explode(F.expr(f"sequence(greatest(0, {LENGTH} - (octet_length(bytes) - before)), least(before, {BEFORE}))"))
    strings = around.where(f"octet_length(bytes) >= {LENGTH}").withColumn("ahead", k)
    strings = strings.withColumn("string", F.md5(F.expr(f"substring(bytes, before - ahead + 1, {LENGTH})"))).select("string", "gram", "doc", "tag", "at", "ahead")
    first = strings.groupBy("string", "gram", "ahead").agg(F.min(F.struct("doc", "tag", "at")).alias("first"))
    again = strings.join(first, ["string", "gram", "ahead"]).where("first <> struct(doc, tag, at)")
    return again.groupBy("doc", "tag", "at").agg(F.min(F.col("at") - F.col("ahead")).alias("start"), (F.max(F.col("at") - F.col("ahead")) + LENGTH).alias("end")).drop("at")


def united(n: int, starts, ends) -> list[tuple[int, int]]:
    """The runs of bytes that the intervals cover."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, np.asarray(starts, dtype=np.int64), 1)
    np.add.at(change, np.asarray(ends, dtype=np.int64), -1)
    covered = np.concatenate(([0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]))
    step = np.diff(covered)
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))


def remove(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) per row of ``docs``."""
    docs = _documents(docs)
    marks = written(_decided(_grams(docs)).groupBy("doc", "tag").agg(  # one document's anchors
        F.collect_list(F.when(F.col("whole"), F.col("at"))).alias("wholes"),
        F.collect_list(F.when(~F.col("whole"), F.struct("gram", "at"))).alias("edges")))
    grams = marks.select(F.explode("edges.gram").alias("gram")).groupBy("gram").count()
    many = stage(grams.where(F.col("count") > crowd).select("gram"))
    around = _surroundings(docs, marks)
    if many.count():  # at most a crowd'th of the edges
        around = written(around)
        found = _sorted_edges(around.join(many, "gram", "left_anti")).unionByName(
            _crowded_edges(around.join(many, "gram", "left_semi")).select("doc", "tag", "start", "end"))
    else:
        found = _sorted_edges(around)
    lists = found.groupBy("doc", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))  # one document's
    # the documents are dealt out once for this join and that of the surroundings
    rows = docs.join(marks.select("doc", "tag", "wholes"), ["doc", "tag"], "left").join(lists, ["doc", "tag"], "left")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = [[], [], [], [], []]
                part = batch.slice(at, 64)
                for key, text, wholes, starts, ends in zip(*(part.column(c).to_pylist() for c in ("doc", "text", "wholes", "starts", "ends"))):
                    raw = text.encode("utf-8", "surrogatepass")
                    n = len(raw)
                    # a whole surrounding near the end is shorter; one too short for a string holds none
                    own = [(max(at_ - BEFORE, 0), min(at_ + LENGTH, n)) for at_ in wholes or []]
                    own = [(a, b) for a, b in own if b - a >= LENGTH] + list(zip(starts or [], ends or []))
                    gone = united(n, *zip(*own)) if own else []
                    edges = [0, *(x for pair in gone for x in pair), n]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    for column, value in zip(out, (None if key == NOBODY else key, n, n - len(kept), len(gone), kept)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.select("doc", "text", "wholes", "starts", "ends").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``remove`` with the remaining bytes as their SHA-256."""
    return remove(docs, crowd).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
