"""Mixing sources to target weights by temperature, with DataFrame operations only.

Every source's share of the tokens is raised to one exponent and normalised. The exponent is found by bisection: the
largest one whose weights reach a target entropy, or the smallest one at which no source is repeated more often than a
limit. The weights are then realised under a token budget: a source is read in passes, each a permutation of its
documents by hash; the last pass stops where the source's part of the budget ends. The mixture is dealt into blocks that
hold every source in its weight.

Defined cases: a null ``source`` is a source of its own; null and empty texts hold no tokens, cost nothing and stay; a
source without tokens has weight 0 and is read once; rows that repeat a doc_id within a source stand together in the
permutation, and a null doc_id counts as the empty id; an empty table gives an empty mixture; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import stage

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bisection steps done by one job, which weighs 2**STEPS - 1 exponents at once; and jobs.
STEPS, JOBS = 6, 5
#: Slices of a permutation; only the slice in which a budget ends is sorted.
SLICES = 4096
#: A table of sources up to this many rows is broadcast; beyond it, documents join it by a shuffle.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _reaches(points: DataFrame, entropy: float | None, repetition: float | None, budget: int | None) -> Column:
    """Whether an exponent's weights meet the aim; true up to some exponent (entropy) or from one on (repetition)."""
    if entropy is not None:
        h = F.log("z") - F.col("a") * F.col("zl") / F.col("z")
        return h >= F.lit(entropy) * F.log(F.col("n").cast("double"))
    if budget is None:  # the budget that reads the least repeated source exactly once
        return F.col("most") / F.col("least") <= F.lit(float(repetition))
    return F.lit(float(budget)) * F.col("most") / F.col("z") <= F.lit(float(repetition))


def exponent(totals: DataFrame, entropy: float | None = None, repetition: float | None = None,
             budget: int | None = None) -> float:
    """The exponent in [0, 1], to 2**-30. ``totals``: one row per source, ``tokens`` above 0.

    ``entropy``: part of the largest possible entropy that the weights have to reach. ``repetition``: how often a
    source may be read. Exactly one of them is given. 1 if the natural shares reach the entropy; 0 if equal weights
    respect the limit, or if no exponent reaches the entropy.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give entropy or repetition")
    whole = totals.agg(F.sum("tokens").alias("all"), F.count(F.lit(1)).alias("n")).first()
    shares = stage(totals.select((F.col("tokens") / F.lit(whole["all"])).alias("p"), "tokens"))

    def met(exponents: list[float]) -> dict[float, bool]:
        a = F.explode(F.array(*map(F.lit, exponents))).alias("a")
        power = F.pow("p", "a")
        points = shares.select("*", a).groupBy("a").agg(
            F.count(F.lit(1)).alias("n"), F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("zl"),
            F.max(power / F.col("tokens")).alias("most"), F.min(power / F.col("tokens")).alias("least"))
        return {r["a"]: r["ok"] for r in points.select("a", _reaches(points, entropy, repetition, budget).alias("ok")).collect()}

    ends = met([0.0, 1.0])
    if not ends:
        return 1.0
    if entropy is not None:
        if ends[1.0]:
            return 1.0
        if not ends[0.0]:
            return 0.0
    elif ends[0.0]:
        return 0.0
    low, width = 0.0, 1.0
    for _ in range(JOBS):
        width /= 2 ** STEPS
        inner = [low + width * i for i in range(1, 2 ** STEPS)]
        ok = met(inner)
        low += width * sum(ok[a] == (entropy is not None) for a in inner)
    return low if entropy is not None else low + width


def plan(docs: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: int | None = None,
         source: str = "source", tokens: Column | None = None) -> DataFrame:
    """One row per source: ``source``, tokens, weight, target (tokens of the mixture), full (whole passes), rest.

    ``budget`` None takes the smallest budget that reads every source at least once.
    """
    tokens = words(F.col("text")) if tokens is None else tokens
    totals = stage(docs.groupBy(F.col(source).alias("source")).agg(F.sum(tokens).alias("tokens")))
    live = totals.where("tokens > 0")
    a = exponent(live, entropy, repetition, budget)
    all_tokens = live.agg(F.sum("tokens")).first()[0] or 0
    raw = live.withColumn("power", F.pow(F.col("tokens") / F.lit(all_tokens), F.lit(a)))
    norm = raw.agg(F.sum("power")).first()[0] or 1.0
    weighed = raw.withColumn("weight", F.col("power") / F.lit(norm))
    if budget is None:
        cover = weighed.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
        target = F.greatest(F.round(F.col("weight") * F.lit(cover)).cast("long"), F.col("tokens"))
    else:
        target = F.round(F.col("weight") * F.lit(float(budget))).cast("long")
    weighed = weighed.select("source", "tokens", "weight", target.alias("target"))
    silent = totals.where("tokens = 0").select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("target"))
    return stage(weighed.unionByName(silent).select(
        "*", F.expr("CASE WHEN tokens = 0 THEN 1L ELSE target div tokens END").alias("full"),
        F.expr("CASE WHEN tokens = 0 THEN 0L ELSE target % tokens END").alias("rest")))


def _key(seed: int, turn: Column, doc_id: Column) -> Column:
    """Place of a document in one pass: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _slice(key: Column, digits: int) -> Column:
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def _with_plan(docs: DataFrame, sources: DataFrame, source: str) -> DataFrame:
    few = sources.count() <= BROADCAST_SOURCES
    side = sources.select(*[F.col(c).alias(f"__{c}") for c in sources.columns])
    side = F.broadcast(side) if few else side
    return docs.join(side, docs[source].eqNullSafe(F.col("__source")))


def cuts(docs: DataFrame, sources: DataFrame, seed: int = 0, source: str = "source", doc_id: str = "doc_id",
         tokens: Column | None = None) -> DataFrame:
    """``sources`` with ``cut``: the last key of the partial pass that still fits ``rest`` (null: none fits).

    A pass is summed by slices of its key; only the slice in which the budget ends is read again and sorted.
    """
    tokens = words(F.col("text")) if tokens is None else tokens
    rows = _with_plan(docs, sources.where("rest > 0").select("source", "full", "rest"), source).select(
        "__source", "__rest", tokens.alias("__tokens"), _key(seed, F.col("__full"), F.col(doc_id)).alias("__key"))
    rows = stage(rows.withColumn("__slice", F.floor(_slice(F.col("__key"), 8) / F.lit(2 ** 32 // SLICES))))
    before = Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    # a source has at most SLICES rows here
    ends = (rows.groupBy("__source", "__rest", "__slice").agg(F.sum("__tokens").alias("s"))
            .withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0)))
            .where("before <= __rest and before + s > __rest").select(
                F.col("__source").alias("source"), F.col("__slice").alias("slice"), "before"))
    few = F.broadcast(ends) if sources.count() <= BROADCAST_SOURCES else ends
    last = rows.join(few, F.col("__source").eqNullSafe(F.col("source")) & (F.col("__slice") == F.col("slice")))
    upto = Window.partitionBy("__source").orderBy("__key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = (last.withColumn("upto", F.col("before") + F.sum("__tokens").over(upto)).where("upto <= __rest")
            .groupBy("__source").agg(F.max("__key").alias("key")))
    found = (ends.select(F.col("source").alias("e_source"), "slice")
             .join(fits, F.col("e_source").eqNullSafe(F.col("__source")), "left")
             # all slices before the last one fit; a key below every key of the slice if none in it does
             .select("e_source", F.coalesce("key", F.lower(F.lpad(F.conv((F.col("slice") * F.lit(2 ** 32 // SLICES)).cast("string"), 10, 16), 8, "0"))).alias("cut")))
    return sources.join(found, F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source")


def _mixture(docs: DataFrame, sources: DataFrame, seed: int, blocks: int, source: str, doc_id: str) -> DataFrame:
    """``docs`` once per pass that reads them, with ``__pass`` and ``__block``. ``sources``: ``cuts``."""
    turns = F.explode(F.expr("sequence(0L, CASE WHEN __rest > 0 THEN __full ELSE __full - 1 END)"))
    some = sources.where("full > 0 or rest > 0").select("source", "tokens", "target", "full", "rest", "cut")
    rows = _with_plan(docs, some, source).withColumn("__pass", turns)
    rows = rows.withColumn("__key", _key(seed, F.col("__pass"), F.col(doc_id)))
    rows = rows.where("__pass < __full OR __key <= __cut")
    at = (F.col("__pass") + _slice(F.col("__key"), 8) / F.lit(float(2 ** 32)))
    passes = F.when(F.col("__target") > 0, F.col("__target") / F.col("__tokens")).otherwise(F.lit(1.0))
    return rows.withColumn("__block", F.least(F.floor(F.lit(float(blocks)) * at / passes), F.lit(blocks - 1)).cast("long"))


def mix(docs: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: int | None = None,
        seed: int = 0, blocks: int = 64, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mixture: every row of ``docs`` once per pass that reads it, with ``mix_pass`` and ``mix_block`` (in place of columns so named).

    Sorting by (mix_block, a hash) gives the training order: each of ``blocks`` blocks holds about the same number of
    tokens, every source in its weight.
    """
    sources = stage(cuts(docs, plan(docs, entropy, repetition, budget, source), seed, source, doc_id))
    rows = _mixture(docs, sources, seed, blocks, source, doc_id)
    own = [c for c in docs.columns if c not in ("mix_pass", "mix_block")]
    return rows.select(*own, F.col("__pass").alias("mix_pass"), F.col("__block").alias("mix_block"))


def mixed_documents(docs: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: int | None = None,
                    seed: int = 0, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mixture with the columns of ``docs`` alone: a document read in several passes is there as often."""
    sources = stage(cuts(docs, plan(docs, entropy, repetition, budget, source), seed, source, doc_id))
    return _mixture(docs, sources, seed, 1, source, doc_id).select(*docs.columns)
