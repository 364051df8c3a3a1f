"""Runs of words of a text: their hash buckets, and the runs themselves where a bucket is wanted.

Words are stretches of a-z, 0-9 and Devanagari in lower-case texts. A task works on slices of about
``SLICE`` bytes, whole rows each, so its memory does not grow with its share of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at together; a longer row is a slice of its own.
SLICE = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def _powers(of: int, count: int, kept: dict[int, np.ndarray]) -> np.ndarray:
    """The first powers of an odd number modulo 2 ** 64; ``kept`` has those of the longest slice so far."""
    if of not in kept or len(kept[of]) < count:
        out = np.full(max(count, SLICE), of, np.uint64)
        out[0] = 1
        kept[of] = np.cumprod(out)
    return kept[of][:count]


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """Sorted, without repeats; ``np.unique`` hashes, which took 50 times as long."""
    numbers = np.sort(numbers)
    return numbers[np.diff(numbers, prepend=-1) != 0]


def _in_words(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to a word; U+0900 to U+097F are E0 A4 or E0 A5 and one byte more."""
    word = _WORD[raw]
    lead = np.flatnonzero(raw == 0xE0)
    lead = lead[(raw[lead + 1] & 0xFE) == 0xA4]
    for k in range(3):
        word[lead + k] = True
    return word


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, bytes, and where each row ends in them."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + SLICE, "right")) - 1)
        yield low, high, data[at[low]:at[high]], at[low + 1:high + 1] - at[low]
        low = high


class _Runs:
    """The runs of ``n`` words in rows that all end in a space: row, number of the first word and hash bucket."""

    def __init__(self, raw: np.ndarray, row_ends: np.ndarray, n: int, buckets: int, kept: dict):
        self.raw, self.word = raw, _in_words(raw)
        edges = np.flatnonzero(np.diff(self.word.view(np.int8), prepend=0, append=0))
        self.starts, self.ends = edges[0::2], edges[1::2]
        rows = np.repeat(np.arange(len(row_ends)), np.diff(np.searchsorted(self.starts, row_ends), prepend=0))
        count = max(len(rows) - n + 1, 0)
        self.first = np.flatnonzero(rows[:count] == rows[n - 1:n - 1 + count])
        self.row = rows[self.first]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(raw), kept), out=sums[1:])
        words = (sums[self.ends] - sums[self.starts]) * _powers(_BACK, len(raw), kept)[self.starts]
        run = np.zeros(len(self.first), np.uint64)
        for k in range(n):
            run = (run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[self.first + k]
        run = (run ^ (run >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        self.bucket = ((run >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)

    def texts(self, chosen: np.ndarray, n: int) -> pa.Array:
        """The chosen runs, one space between words."""
        at = np.concatenate(([0], np.cumsum(self.ends - self.starts)))
        words = pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(at.astype(np.int64)),
                                                 pa.py_buffer(np.ascontiguousarray(self.raw[self.word])))
        parts = [words.take(pa.array(self.first[chosen] + k)) for k in range(n)]
        return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))


def bucket_sums(n: int, buckets: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From text and worth: each bucket's sum of worth over the rows with a run in it, once per row, and its runs."""
    def run(batches):
        most, held, kept = np.zeros(buckets), np.zeros(buckets, np.int64), {}
        for batch in batches:
            worth = batch.column(1).to_numpy(zero_copy_only=False)
            for low, high, raw, row_ends in _slices(batch.column(0)):
                runs = _Runs(raw, row_ends, n, buckets, kept)
                row, bucket = np.divmod(_distinct(runs.row * buckets + runs.bucket), buckets)
                most += np.bincount(bucket, worth[low:high][row], buckets)
                held += np.bincount(runs.bucket, minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(most[at]), pa.array(held[at])], ["bucket", "most", "held"])

    return run


def runs_in(n: int, buckets: int, wanted: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From text and value: the distinct runs of each row that lie in ``wanted`` buckets, each with the row's value."""
    def run(batches):
        kept = {}
        for batch in batches:
            for low, high, raw, row_ends in _slices(batch.column(0)):
                runs = _Runs(raw, row_ends, n, buckets, kept)
                chosen = np.flatnonzero(wanted[runs.bucket])
                found = pa.table({"row": runs.row[chosen] + low, "ngram": runs.texts(chosen, n)})
                found = found.group_by(["row", "ngram"], use_threads=False).aggregate([]).combine_chunks()
                values = batch.column(1).take(found["row"].combine_chunks())
                yield pa.RecordBatch.from_arrays([found["ngram"].combine_chunks().cast(pa.string()), values], ["ngram", "v"])

    return run
