"""Periodic runs of words: stretches in which every word equals the one a period earlier, as long as they reach.

The words of a text are numbered in two opposite orders. For each order, Baier's grouping (phase one of his suffix sorter)
yields the Lyndon array: suffixes start in groups by their first word; the highest group is taken out, each of its members
is appended to the nearest position to its left that is still in, and those positions move into groups just above the rest
of their own, the more members they took the higher. When a position is taken out, the length it has gathered is that of the
longest Lyndon word starting there, so no suffix is ever sorted. By the runs theorem, every run has such a Lyndon word of one
of the orders as its root. Roots are extended to both sides by the longest common extension (hashes of prefixes, binary
search) into runs, and what hashes say is compared word by word.

A run of at least ``LEAST`` = 24 words that spans its period three times has every eight successive words a second time in the
text. Only stretches with this property are grouped: runs lie inside them whole, so nothing is lost.

Each text is taken whole by one task, a row at a time, and nothing is shuffled; work grows with the text's length times the
logarithm of it.

Defined cases: null and empty texts have no words and no runs; an empty table gives an empty result; repeated rows each give
their result; ties between runs go to the smaller start, then the smaller period; other columns pass through, added ones get
the prefix ``run_`` and replace columns of these names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing

#: A run holds its period this many times, and this many words, at least.
TIMES, LEAST = 3, 24
#: Successive words that are looked up a second time. Every run repeats LEAST * (TIMES - 2) // TIMES + 1 of them, or more.
GRAM = 8
WORD = r"[^\x20\x09-\x0D]+"


def lyndon(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word starting at each position of ``ranks``, by Baier's grouping."""
    n = len(ranks)
    order = sorted(range(n), key=ranks.__getitem__)  # stable: positions ascend within a group
    slot = [0] * n  # where a position stands in order
    group = [0] * n  # first slot of a position's group
    size = [0] * (n + 1)
    for k, i in enumerate(order):
        slot[i] = k
        group[i] = k if k == 0 or ranks[order[k - 1]] != ranks[i] else group[order[k - 1]]
        size[group[i]] += 1
    length = [1] * n
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    top = n
    while top:
        first = group[order[top - 1]]
        members = sorted(order[first:top])
        top, own = first, length[members[0]]
        took: dict[int, int] = {}
        for i in members:
            a, b = left[i], right[i]
            if a >= 0:
                right[a] = b
                took[a] = took.get(a, 0) + 1
            if b < n:
                left[b] = a
        for member in members:  # neighbours that left with this group took nothing
            took.pop(member, None)
        if not took:
            continue
        for count in sorted(set(took.values()), reverse=True) if len(took) > 1 else took.values():
            moved = []
            for j, c in took.items():
                if c == count:
                    g = group[j]
                    size[g] -= 1
                    last, at = g + size[g], slot[j]
                    other = order[last]
                    order[at], slot[other], order[last], slot[j] = other, at, j, last
                    length[j] += count * own
                    moved.append(j)
            for j in moved:
                new = group[j] + size[group[j]]
                group[j] = new
            for j in moved:
                size[group[j]] += 1
    return length


def _extended(prefixes: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words from ``a`` and ``b`` on (before them if ``back``) agree, ``most`` at most, by their hashes."""
    low, high = np.zeros_like(most), most.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_] + 1) // 2
        x, y = a[open_], b[open_]
        if back:
            same = hashing.spans(prefixes, x - middle, x) == hashing.spans(prefixes, y - middle, y)
        else:
            same = hashing.spans(prefixes, x, x + middle) == hashing.spans(prefixes, y, y + middle)
        low[open_[same]] = middle[same]
        high[open_[~same]] = middle[~same] - 1


def _agree(codes: np.ndarray, start: int, end: int, period: int) -> bool:
    return bool((codes[start:end - period] == codes[start + period:end]).all())


def _exact(codes: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """Start and end of the run with root ``at``, word by word."""
    differ = np.flatnonzero(codes[:-period] != codes[period:])
    after = np.searchsorted(differ, at)
    start = int(differ[after - 1]) + 1 if after else 0
    return start, (int(differ[after]) if after < len(differ) else len(codes) - period) + period


def _of_stretch(codes: np.ndarray, times: int, least: int) -> set[tuple[int, int, int]]:
    """(start, end, period) of the runs of one stretch."""
    n = len(codes)
    ranks = np.unique(codes, return_inverse=True)[1]
    prefixes = hashing.prefix(hashing.mixed(ranks.astype(np.uint64) + np.uint64(1)))
    found = set()
    for order in (ranks, ranks.max() - ranks):
        root = np.array(lyndon(order.tolist()), dtype=np.int64)
        at = np.flatnonzero(root * times <= n)
        period = root[at]
        ahead = _extended(prefixes, at, at + period, n - at - period, False)
        behind = _extended(prefixes, at, at + period, at, True)
        long_enough = ahead + behind + period >= np.maximum(period * times, least)
        spans = np.stack([at - behind, at + period + ahead, period], axis=1)[long_enough]
        at = at[long_enough]
        for (start, end, p), i in zip(spans.tolist(), at.tolist()):
            if (start, end, p) in found:
                continue
            if not _agree(codes, start, end, p):  # hashes of different words agreed
                start, end = _exact(codes, i, p)
                if end - start < max(p * times, least):
                    continue
            found.add((start, end, p))
    return found


def runs(words: list, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in ``words``, by start, then period; ``times`` is 2 at least."""
    n = len(words)
    if n < least:
        return []
    number = dict(zip(words, range(n)))
    if len(number) == n:
        return []
    codes = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
    prefixes = hashing.prefix(hashing.mixed(codes.astype(np.uint64) + np.uint64(1)))
    gram = min(GRAM, least * (times - 2) // times + 1)
    starts = np.arange(n - gram + 1)
    grams = hashing.spans(prefixes, starts, starts + gram)
    ordered = np.sort(grams)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return []
    repeated = np.concatenate([[False], np.isin(grams, again), [False]])
    edges = np.flatnonzero(repeated[1:] != repeated[:-1])
    found = []
    for a, b in zip(edges[::2].tolist(), (edges[1::2] + gram - 1).tolist()):
        if b - a >= least:
            found += [(a + start, end - start, p) for start, end, p in _of_stretch(codes[a:b], times, least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact ratio of length to period; ties: the first."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """``words`` without those that a run holds after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


_NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed")
_TYPES = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"


def scan(docs: DataFrame, text: str = "text", times: int = TIMES, least: int = LEAST, with_text: bool = True) -> DataFrame:
    """``docs`` with ``run_``: n_runs, start, length, period and exponent_milli of the strongest run, the digests
    runs_sha256 and collapsed_sha256, and ``run_collapsed`` (the text without repeated periods, words joined by one space;
    left out unless ``with_text``)."""
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            words = (value or "").encode().split()  # splits at the same six ASCII characters as WORD
            found = runs(words, times, least)
            start, length, period = _strongest(found) or (None, None, None)
            lines = "".join(f"{a},{b},{c}\n" for a, b, c in found).encode()
            kept = b" ".join(collapsed(words, found))
            rows.append((len(found), start, length, period, period and 1000 * length // period, hashlib.sha256(lines).hexdigest(),
                         hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        frame = pd.DataFrame(rows, columns=_NAMES)
        return frame.astype({c: "Int64" for c in _NAMES[:5]})

    rows = docs.withColumn("__run", F.pandas_udf(judge, _TYPES)(F.col(text)))
    return rows.withColumns({f"run_{c}": F.col(f"__run.{c}") for c in (_NAMES if with_text else _NAMES[:-1])}).drop("__run")


def repeating(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where every tenth ``text`` has a periodic tail: word i from a on becomes word a + (i - a) % p.

    With h the checksum of the id, g = h // 10 and n words: a = g % n, p = 1 + (n - a) // (3 + g % 8). The others, and rows
    without an id, stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("long").cast("string"))
    rows = docs.withColumn("__words", F.when(h % 10 == 0, F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))))
    n, g = F.size("__words").cast("long"), F.floor(h / 10).cast("long")
    rows = rows.withColumn("__at", F.when(n > 0, g % n)).withColumn("__period", 1 + F.floor((n - F.col("__at")) / (3 + g % 8)))
    rest = n - F.col("__at")
    turns = F.flatten(F.array_repeat(F.slice("__words", (F.col("__at") + 1).cast("int"), F.col("__period").cast("int")),
                                     F.ceil(rest / F.col("__period")).cast("int")))
    whole = F.array_join(F.concat(F.slice("__words", 1, F.col("__at").cast("int")), F.slice(turns, 1, rest.cast("int"))), " ")
    return rows.withColumn(text, F.when(F.col("__at").isNotNull(), whole).otherwise(F.col(text))).drop("__words", "__at", "__period")
