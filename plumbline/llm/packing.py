"""Best-two-fit packing of documents into sequences of a fixed length.

A document becomes token ids and an end id. Only a document longer than a sequence is cut: full pieces, and a shorter
first piece if its length is no multiple. Pieces of one length are interchangeable, so the packing is found on the
histogram of lengths (at most ``size`` numbers, whatever the table's size): a bin is filled greedily with the largest
piece that fits; then its smallest piece goes if two unpacked pieces fill the widened gap more tightly. A bin found once
is used as often as the histogram holds its pieces. What comes out is a list of bin patterns, each with slots for ranks
within a length; the pieces get their ranks in Spark and meet their slots in a join.

Defined cases: null and empty texts hold the end id alone; repeated rows are documents of their own; an empty table
gives an empty result. Ids are those of the ``tokenizers`` file: its special token's string becomes its id.
"""

from __future__ import annotations

import base64
import functools
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import stage

SIZE, END_ID = 1024, 2
#: A length's pieces are ranked in so many groups, so that no length is one task.
GROUPS = 256
#: Texts are encoded in pieces of work of so many rows.
ROWS = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(2)
def encoding(path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    import tiktoken
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=vocabulary(path), special_tokens=dict(special))


def default_encoding() -> tuple:
    """The byte-level vocabulary of 50k ids: byte_bpe_50k.json in the form that is fastest to use, special token included."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: a shorter first piece, then full ones."""
    first = n % size or size
    return [(0, min(first, n)), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, tokenizer: tuple | None = None,
           doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32; with its ``ids`` if asked for."""
    names = tokenizer or default_encoding()

    def encode(batches):
        encoder = encoding(*names)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                part = batch.slice(at, ROWS)
                for key, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*encoder.encode(value or "", allowed_special="all"), end_id], dtype="<u4")
                    for k, (start, length) in enumerate(cut(len(ids), size)):
                        own = ids[start:start + length]
                        for name, v in zip(out, (key, k, start, length, zlib.crc32(own.tobytes()), own.tolist() if with_ids else None)):
                            out[name].append(v)
                arrays = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32"))]
                if with_ids:
                    arrays.append(pa.array(out["ids"], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=list(out)[:len(arrays)])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(encode, PIECES + (", ids array<int>" if with_ids else ""))


def best_two_fit(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a bin, number of such bins) for ``histogram`` (length: pieces), largest first."""
    left = Counter({n: c for n, c in histogram.items() if c > 0})
    lengths = sorted(left)
    patterns = []

    def largest(most: int, used: Counter) -> int | None:
        at = bisect_right(lengths, most)
        while at:
            at -= 1
            if left[lengths[at]] > used[lengths[at]]:
                return lengths[at]
        return None

    def two(gap: int, above: int, used: Counter) -> tuple[int, int] | None:
        """The two unpacked pieces that fill ``gap`` best, if they hold more than ``above``."""
        best = None
        for at in range(bisect_right(lengths, gap - 1), 0, -1):
            first = lengths[at - 1]
            if 2 * first <= above:
                break
            if left[first] <= used[first]:
                continue
            used[first] += 1
            second = largest(min(first, gap - first), used)
            used[first] -= 1
            if second and first + second > above:
                best, above = (first, second), first + second
                if above == gap:
                    break
        return best

    while lengths:
        used: Counter = Counter()
        gap, bin_ = size, []
        while (n := largest(gap, used)) is not None:
            bin_.append(n)
            used[n] += 1
            gap -= n
        if gap and len(bin_) > 1:
            smallest = bin_[-1]  # greedy filling goes down in length
            used[smallest] -= 1
            if pair := two(gap + smallest, smallest, used):
                bin_ = [*bin_[:-1], *pair]
            else:
                used[smallest] += 1
            used = Counter(bin_)
        times = min(left[n] // c for n, c in used.items())
        patterns.append((tuple(bin_), times))
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                lengths.remove(n)
    return patterns


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): ranks of a length that take one place in a pattern's bins."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, taken[n], taken[n] + times, sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    return rows


def pack(cuts: DataFrame, size: int = SIZE) -> DataFrame:
    """``cuts`` (with ``length`` and columns that order it) with ``sequence_id`` and ``offset``."""
    spark = cuts.sparkSession
    order = [c for c, kind in cuts.dtypes if not kind.startswith(("array", "map"))]
    cuts = stage(cuts.withColumn("__group", F.pmod(F.xxhash64(*order), F.lit(GROUPS))))
    counts = stage(cuts.groupBy("length", "__group").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    places = slots(best_two_fit(histogram, size))
    # a length has at most GROUPS rows here
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "__group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__group").orderBy(*order)
    ranked = (cuts.join(F.broadcast(base), ["length", "__group"])  # size x GROUPS rows at most
              .withColumn("__rank", F.col("__base") + F.row_number().over(within) - 1))
    table = spark.createDataFrame(places, "p_length long, p_first long, p_end long, p_sequence long, p_offset long")
    # the patterns' slots of one length, as an array in order of rank: bounded by the number of patterns
    lists = table.groupBy("p_length").agg(F.sort_array(F.collect_list(F.struct("p_first", "p_end", "p_sequence", "p_offset"))).alias("p"))
    mine = F.expr("filter(p, s -> s.p_first <= __rank and __rank < s.p_end)[0]")
    out = ranked.join(F.broadcast(lists), F.col("length") == F.col("p_length")).withColumn("__slot", mine)
    return out.select(*[c for c in cuts.columns if c != "__group"],
                      (F.col("__slot.p_sequence") + F.col("__rank") - F.col("__slot.p_first")).alias("sequence_id"),
                      F.col("__slot.p_offset").alias("offset"))


def pack_documents(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, tokenizer: tuple | None = None) -> DataFrame:
    return pack(pieces(docs, size, end_id, tokenizer), size)
