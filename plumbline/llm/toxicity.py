"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Every n-gram of 3 to 6 lower-cased code points is hashed into ``BUCKETS``. From labelled texts come, per bucket, the
numbers of toxic and clean texts that hold it; the log ratio of their smoothed shares is the feature's scale. A feature
is that scale times the logarithm of the n-gram's count (repetition says little), over the root of the text's length; and a logistic regression with an L2 penalty weighs the
``FEATURES`` buckets that separate the classes best. The model is learned from at most ``SAMPLE`` labelled texts (those
whose ids hash lowest); scoring is one map over all texts.

Defined cases: null and empty texts get the score of a text without features; labels that are null, or whose document is
missing, teach nothing; a document labelled twice counts as toxic if one label says so; without labels of both classes
every score is the share of toxic labels (0 without any); repeated rows each get their score; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage

#: Labelled texts that the classifier is fitted on at most.
SAMPLE = 20_000
NGRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 20
FEATURES = 1 << 13
#: Texts of so many code points are hashed at once; one longer text is a piece of its own.
CHARS = 1 << 18
#: Counted buckets that a task hands on at a time.
ROWS = 1 << 16
PENALTY, ROUNDS = 1e-4, 500
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Model:
    """``at``: the feature of a bucket or -1; ``value``: weight times scale of a feature; ``bias``: of every text."""
    at: np.ndarray
    value: np.ndarray
    bias: float


def _chunks(texts):
    """(first text, code points of several texts, their number per text)."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        held.append(codes)
        size += len(codes)
        if size >= CHARS:
            yield start, np.concatenate(held), np.array([len(c) for c in held])
            start, held, size = i + 1, [], 0
    if held:
        yield start, np.concatenate(held), np.array([len(c) for c in held])


def hits(codes: np.ndarray, lengths: np.ndarray, at: np.ndarray | None):
    """(text, feature) of every n-gram; with ``at`` only of those that are features."""
    text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    rolled = np.zeros(len(codes), dtype=np.uint64)
    points = codes.astype(np.uint64) + np.uint64(1)
    for n in range(1, max(NGRAMS) + 1):
        count = len(codes) - n + 1
        if count <= 0:
            return
        rolled = rolled[:count] * _FACTOR + points[n - 1:]
        if n in NGRAMS:
            mixed = (rolled ^ (rolled >> np.uint64(29))) * _MIX
            bucket = (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)
            feature = bucket if at is None else at[bucket]
            keep = text[:count] == text[n - 1:]
            if at is not None:
                keep &= feature >= 0
            yield text[:count][keep], feature[keep]


def counted(codes: np.ndarray, lengths: np.ndarray, at: np.ndarray):
    """(text, feature, occurrences) of the features in several texts."""
    found = list(hits(codes, lengths, at))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    pair, n = np.unique(np.concatenate([t.astype(np.int64) * FEATURES + f for t, f in found]), return_counts=True)
    return pair // FEATURES, pair % FEATURES, n


def _presence(batches):
    """Per bucket, the toxic and the clean texts of this task that hold it."""
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    for frame in batches:
        toxic = frame["toxic"].to_numpy()
        for first, codes, lengths in _chunks(frame["text"]):
            found = [t.astype(np.int64) * BUCKETS + f for t, f in hits(codes, lengths, None)]
            if not found:
                continue
            pair = np.unique(np.concatenate(found))
            label = toxic[first + pair // BUCKETS]
            for k in (0, 1):
                counts[k] += np.bincount(pair[label == k] % BUCKETS, minlength=BUCKETS)
    used = np.flatnonzero(counts[0] + counts[1])
    for at in range(0, len(used), ROWS):
        some = used[at:at + ROWS]
        yield pd.DataFrame({"bucket": some, "toxic": counts[1, some], "clean": counts[0, some]})


def _rates(at: np.ndarray):
    def run(batches):
        for frame in batches:
            out = []
            for first, codes, lengths in _chunks(frame["text"]):
                text, feature, n = counted(codes, lengths, at)
                ends = np.searchsorted(text, np.arange(len(lengths) + 1))
                for i, length in enumerate(lengths):
                    a, b = ends[i], ends[i + 1]
                    out.append((int(frame["toxic"].iloc[first + i]), int(length), feature[a:b].astype("<u2").tobytes(), np.minimum(n[a:b], 65535).astype("<u2").tobytes()))
            yield pd.DataFrame(out, columns=["toxic", "length", "features", "counts"])
    return run


def _norm(lengths: np.ndarray) -> np.ndarray:
    """What counts are divided by: a text's size, so that long clean texts don't add up to toxic ones."""
    return np.sqrt(lengths + 50.0) / 8.0


def labelled(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of at most ``sample`` labelled documents that aren't held out."""
    known = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
             .where(~held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    chosen = docs.join(F.broadcast(known), "doc_id")  # sample rows at most
    return stage(chosen.select(F.coalesce("text", F.lit("")).alias("text"), F.col("__toxic").alias("toxic")))


def fit(rows: DataFrame) -> Model:
    """``rows``: text, toxic (0 or 1), bounded."""
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        share = 1.0 - 1e-9 if toxic else 1e-9
        return Model(np.full(BUCKETS, -1, np.int32), np.zeros(1), float(np.log(share / (1 - share))))
    # a row per bucket at most, read twice
    counts = stage(rows.mapInPandas(_presence, "bucket long, toxic long, clean long").groupBy("bucket").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic + clean >= 3"))
    held = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    ratio = F.log((F.col("toxic") + 1) / F.lit((held["t"] or 0) + BUCKETS)) - F.log((F.col("clean") + 1) / F.lit((held["c"] or 0) + BUCKETS))
    gain = F.col("ratio") * (F.col("toxic") / F.lit(toxic) - F.col("clean") / F.lit(clean))
    best = counts.withColumn("ratio", ratio).orderBy(gain.desc(), "bucket").limit(FEATURES).select("bucket", "ratio").toPandas()
    at = np.full(BUCKETS, -1, np.int32)
    at[best["bucket"]] = np.arange(len(best))
    scale = best["ratio"].to_numpy(float)
    # the features of a bounded sample, two bytes each
    frame = rows.mapInPandas(_rates(at), "toxic int, length long, features binary, counts binary").toPandas()
    sizes = frame["features"].map(len).to_numpy() // 2
    row = np.repeat(np.arange(len(frame), dtype=np.int32), sizes)
    feature = np.frombuffer(b"".join(frame["features"]), dtype="<u2").astype(np.int32)
    x = np.log1p(np.frombuffer(b"".join(frame["counts"]), dtype="<u2")) * scale[feature] / _norm(frame["length"].to_numpy())[row]
    weight, bias = _logistic(row, feature, x, frame["toxic"].to_numpy(float), len(scale))
    return Model(at, weight * scale, bias)


def _logistic(row, feature, x, y, n_features):
    """L2 logistic regression, classes balanced, by accelerated gradient steps of fixed size."""
    n = len(y)
    each = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    # the largest curvature, bounded by power iteration
    v = np.ones(n_features + 1) / np.sqrt(n_features + 1)
    for _ in range(20):
        u = np.bincount(row, x * v[feature], n) + v[-1]
        v = np.append(np.bincount(feature, x * u[row] * each[row], n_features), (u * each).sum()) / n
        top = np.linalg.norm(v)
        v /= top
    step = 1.0 / (top / 4 + PENALTY)
    w = z = np.zeros(n_features + 1)
    momentum = 1.0
    for _ in range(ROUNDS):
        margin = np.bincount(row, x * z[feature], n) + z[-1]
        error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y) * each / n
        gradient = np.append(np.bincount(feature, x * error[row], n_features) + PENALTY * z[:-1], error.sum())
        nearer = z - step * gradient
        after = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        z, w, momentum = nearer + (momentum - 1) / after * (nearer - w), nearer, after
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS and FEATURES numbers

    def of(texts: pd.Series) -> pd.Series:
        m, out = shared.value, np.empty(len(texts))
        for first, codes, lengths in _chunks(texts):
            text, feature, n = counted(codes, lengths, m.at)
            sums = np.bincount(text, np.log1p(np.minimum(n, 65535)) * m.value[feature], len(lengths))
            out[first:first + len(lengths)] = sums / _norm(lengths) + m.bias
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return docs.withColumn(into, F.pandas_udf(of, "double")(F.col(text)))


def held_out(doc_id: str = "doc_id") -> Column:
    """A fifth of the documents, by a checksum of the id's decimal digits."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with held_out, score, predicted (1 from a score of 0.5 on); learned from what isn't held out."""
    model = fit(labelled(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), held_out(), sample))
    return score(docs, model).withColumns({"held_out": held_out(), "predicted": (F.col("score") >= 0.5).cast("int")})
