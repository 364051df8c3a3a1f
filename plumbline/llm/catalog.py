"""Queries over the text tables, one per operator, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, chat, jaccard, licenses, mixing, neardup, packing, pages, runs, secrets, suffixes, toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Parameters of the queries.
ENTROPY = 0.97


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


_WORD = mixing.WORD
MIX_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS n_tokens FROM documents),
t AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
l AS (SELECT * FROM t WHERE tokens > 0),
s AS (SELECT list(tokens::DOUBLE / (SELECT sum(tokens) FROM l)::DOUBLE) AS p FROM l),
b(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN h >= {ENTROPY} * ln(len(p)) THEN mid ELSE lo END, CASE WHEN h >= {ENTROPY} * ln(len(p)) THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, p, mid, ln(z) - mid * zl / z AS h FROM (
    SELECT i, lo, hi, p, (lo + hi) / 2 AS mid, list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) AS z,
      list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2) * ln(x))) AS zl FROM b, s)) WHERE i < 30),
e AS (SELECT CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= {ENTROPY} * ln(len(p)) THEN 1.0
  WHEN ln(len(p)) < {ENTROPY} * ln(len(p)) THEN 0.0 ELSE (SELECT lo FROM b WHERE i = 30) END AS a FROM s),
w AS (SELECT source, tokens, power / sum(power) OVER () AS weight FROM (
  SELECT source, tokens, pow(tokens::DOUBLE / (SELECT sum(tokens) FROM l)::DOUBLE, (SELECT a FROM e)) AS power FROM l)),
g AS (SELECT source, tokens, greatest(round(weight * (SELECT max(tokens / weight) FROM w))::BIGINT, tokens) AS target FROM w),
q AS (SELECT source, tokens, target, target // tokens AS full_passes, target % tokens AS rest FROM g
  UNION ALL SELECT source, 0, 0, 1, 0 FROM t WHERE tokens = 0),
r AS (SELECT d.doc_id, d.source, n_tokens, tokens, target, full_passes, rest, turn AS mix_pass, md5('0:' || turn || ':' || coalesce(d.doc_id::VARCHAR, '')) AS k
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source, unnest(range(0, full_passes + (rest > 0)::BIGINT)) AS u(turn)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, mix_pass ORDER BY k RANGE UNBOUNDED PRECEDING) AS upto FROM r)
SELECT doc_id, source, n_tokens, mix_pass::BIGINT AS mix_pass, least(floor(64.0 * (mix_pass + ('0x' || k[1:8])::BIGINT / 4294967296.0)
  / CASE WHEN target > 0 THEN target::DOUBLE / tokens ELSE 1.0 END), 63)::BIGINT AS mix_block
FROM c WHERE mix_pass < full_passes OR upto <= rest"""


@query("op1_temperature_mix", MIX_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources flattened to 97 % of the largest entropy, every document at least once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, entropy=ENTROPY).select(
        "doc_id", "source", mixing.words(F.col("text")).alias("n_tokens"), "mix_pass", "mix_block")


@query("op2_secret_links")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("secret_assign").alias("n_assign"), F.col("secret_access").alias("n_access"),
                        F.col("secret_hex").alias("n_hex"), F.col("secret_base_sha256").alias("base_sha256"),
                        F.col("secret_spans").alias("spans"))


@query("op5_best_two_fit")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.classify(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


@query("op10_transcripts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, written as transcripts in several styles, parsed back into turns.

    The model is counted on the conversations that aren't held out (four fifths by checksum of the id).
    """
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    known = F.when(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))) % 5 != 0, F.col("role"))
    return chat.format_chats(chat.transcribed(talks).withColumn("role", known))


@query("op4_host_paths")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    text = pages.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op9_ngram_jaccard")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: five words, similarity of at least 0.75."""
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte covered by a string of 100 bytes that starts earlier goes, over all whole texts."""
    return suffixes.digests(table(spark, sf_dir, "documents"))


@query("op7_graph_search")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector, among all others."""
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


@query("op3_embedding_near_copies")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 and more among all embeddings."""
    return neardup.near_copies(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _centroid_sql(rounds: int = centroids.ROUNDS, k: int = centroids.CLUSTERS, seed: int = centroids.SEED) -> str:
    """The rounds written out, one after the other."""
    def assigned(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (SELECT rid, vec_id, v, c, d FROM (SELECT x.rid, x.vec_id, x.v, c.c,
  list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT AS d FROM kept x, c{n} c)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"""

    def moved(n: int) -> str:
        return f"""c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{n}, range(1, 65) AS t(i) GROUP BY c, i) GROUP BY c) m ON m.c = c.c)"""

    steps = ",\n".join(f"{assigned(n)},\n{moved(n)}" for n in range(rounds))
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
  list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k}),
{steps},
{assigned(rounds)}
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} m ON m.c = a.c"""


@query("op11_ptolemaic_centroids", _centroid_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in eight clusters, after ten rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents; every tenth gets a periodic tail first."""
    docs = runs.repeating(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return runs.scan(docs, with_text=False).select("doc_id", *[F.col(f"run_{c}").alias(c) for c in names])


def _license_sql() -> str:
    """Every block against every template."""
    quoted = [[f"'{w}'" for w in sorted(set(licenses.tokens_of(t)))] for _, t in licenses.TEMPLATES]
    rows = ",\n".join(f"('{label}', [{', '.join(q)}], {licenses.needed(len(q))})" for (label, _), q in zip(licenses.TEMPLATES, quoted))
    named = [(licenses.tokens_of(p), label) for p, label in licenses.PHRASES]
    places = " || ".join(
        "list_filter(range(n), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{t}'" for k, t in enumerate(tokens)) + ")" for tokens, _ in named)
    labels = " || ".join(
        "CASE WHEN len(list_filter(range(n), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{t}'" for k, t in enumerate(tokens))
        + f")) > 0 THEN ['{label}'] ELSE [] END" for tokens, label in named)
    return rf"""WITH t(label, words, need) AS (VALUES {rows}),
d AS MATERIALIZED (SELECT rid, doc_id, w, len(w) AS n FROM (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
p AS (SELECT rid, doc_id, n, {places} AS spots, list_sort(list_distinct({labels})) AS named FROM d),
b AS (SELECT rid, w[s + 1:s + 128] AS held FROM d, unnest(range(0, greatest(n - 64, 1), 64)) AS u(s)),
m AS (SELECT rid, list(DISTINCT label) AS held, max(len(list_intersect(words, held)) / len(words)) AS most
  FROM b, t WHERE len(list_intersect(words, held)) >= need GROUP BY rid)
SELECT doc_id, n AS n_words, len(spots)::BIGINT AS n_base, list_min(spots) AS first_word, list_max(spots) AS last_word, array_to_string(named, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(named || coalesce(m.held, []))), ',') AS labels,
  greatest(coalesce(most, 0.0), CASE WHEN len(spots) > 0 THEN {licenses.NAMED} ELSE 0.0 END)::DOUBLE AS score
FROM p LEFT JOIN m ON m.rid = p.rid"""


@query("op13_license_join", _license_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.col(f"license_{c}").alias(c) for c in names])
