"""Keyword grouping (section 2.17). Keywords are the page addresses and the part descriptions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import keywords as k
from .base import entry

book: dict = {}

#: search-like phrases from every page: host words and language, punctuation and case as they come
PAGES_SQL = ("(SELECT page_id, regexp_replace(split_part(split_part(url, '//', 2), '?', 1), '[./]+', ' ', 'g') AS kw, "
             "url FROM pages)")


def pages(t) -> DataFrame:
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("?"), F.lit(1))
    return t("pages").select("page_id", F.regexp_replace(host, "[./]+", " ").alias("kw"), "url")


PARTS_SQL = """(SELECT p_partkey, p_size, CASE p_partkey % 5 WHEN 0 THEN 'Best ' || p_name || ' price in Pune!'
 WHEN 1 THEN p_name || ' home delivery' WHEN 2 THEN 'what is ' || p_name WHEN 3 THEN p_name || ' near me'
 ELSE p_name || ' ' || lower(p_type) END AS kw FROM part)"""


def parts(t) -> DataFrame:
    n, key = F.col("p_name"), F.col("p_partkey") % 5
    kw = (F.when(key == 0, F.concat(F.lit("Best "), n, F.lit(" price in Pune!")))
          .when(key == 1, F.concat(n, F.lit(" home delivery"))).when(key == 2, F.concat(F.lit("what is "), n))
          .when(key == 3, F.concat(n, F.lit(" near me"))).otherwise(F.concat(n, F.lit(" "), F.lower("p_type"))))
    return t("part").select("p_partkey", "p_size", kw.alias("kw"))


NORM = "trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s&''-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@entry(book, "txt_normalise", f"""
WITH r AS (SELECT text AS raw, count(*) AS n FROM conversations GROUP BY 1), k AS (SELECT *, {NORM.format(c='raw')} AS keyword FROM r)
SELECT keyword, min(raw) AS raw, count(*) AS spellings, CAST(sum(n) AS BIGINT) AS "rows" FROM k WHERE keyword <> '' GROUP BY 1""")
def _(t):
    return k.txt_normalise(t("conversations"), "text")


@entry(book, "txt_tokens", f"""
WITH k AS (SELECT DISTINCT {NORM.format(c='kw')} AS keyword FROM {PAGES_SQL}),
 w AS (SELECT DISTINCT keyword, unnest(string_split(keyword, ' ')) AS token FROM k)
SELECT token, count(*) AS n FROM w GROUP BY 1""")
def _(t):
    return k.token_counts(k.txt_normalise(pages(t), "kw"))


@entry(book, "txt_spelling")
def _(t):
    return k.txt_spelling(k.txt_normalise(pages(t), "kw"))


FACET_SQL = f"""
WITH k AS (SELECT DISTINCT {NORM.format(c='kw')} AS keyword FROM {PARTS_SQL}),
 f AS (SELECT keyword, CASE WHEN regexp_matches(keyword, '\\bwhat is\\b') THEN 'what is' END AS info,
  CASE WHEN regexp_matches(keyword, '\\bhome delivery\\b') THEN 'home delivery' END AS delivery,
  CASE WHEN regexp_matches(keyword, '\\bnear me\\b') THEN 'near me' END AS near_me,
  CASE WHEN regexp_matches(keyword, '\\bprice\\b') THEN 'price' END AS price,
  trim(regexp_replace(regexp_replace(keyword, '\\b(what is|home delivery|near me|price|pune|in|best)\\b', ' ', 'g'), '\\s+', ' ', 'g'))
  AS topic FROM k)"""


def facets() -> dict[str, list[str]]:
    """The list the library comes with, and the city that the made-up keywords name."""
    return {**k.load_facets(), "city": ["pune"]}


@entry(book, "txt_facets", FACET_SQL + """
SELECT keyword, info AS facet_info, delivery AS facet_delivery, near_me AS facet_near_me, price AS facet_price, topic,
 CASE WHEN info IS NOT NULL THEN 'info' WHEN delivery IS NOT NULL THEN 'delivery' WHEN near_me IS NOT NULL THEN 'near_me'
 WHEN price IS NOT NULL THEN 'price' END AS lead FROM f""")
def _(t):
    return k.txt_facets(k.txt_normalise(parts(t), "kw"), "keyword", facets()).select(
        "keyword", "facet_info", "facet_delivery", "facet_near_me", "facet_price", "topic", "lead")


@entry(book, "txt_intent", FACET_SQL + """
SELECT CASE WHEN info IS NOT NULL THEN 'informational' WHEN delivery IS NOT NULL THEN 'transactional'
 WHEN near_me IS NOT NULL THEN 'local' ELSE 'commercial' END AS intent, count(*) AS keywords FROM f GROUP BY 1""")
def _(t):
    read = k.txt_facets(k.txt_normalise(parts(t), "kw"), "keyword", facets())
    return read.groupBy(k.txt_intent().alias("intent")).agg(F.count("*").alias("keywords"))


EMBED_SQL = """
WITH d AS (SELECT DISTINCT p_name AS text FROM part),
 w AS (SELECT text, ' ' || unnest(string_split(text, ' ')) || ' ' AS p FROM d),
 s AS (SELECT text, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM w, (VALUES (2), (3), (4)) v(n) WHERE n <= length(p)),
 tf AS (SELECT text, substring(p, i, n) AS gram, count(*) AS tf FROM s GROUP BY 1, 2),
 df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1),
 x AS (SELECT text, gram, (1 + ln(tf)) * (ln(((SELECT count(*) FROM d) + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (gram)),
 e AS (SELECT text, gram, w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS weight FROM x)"""


@entry(book, "txt_embed", EMBED_SQL + " SELECT * FROM e", "weight", 8)
def _(t):
    return k.txt_embed(t("part"), "p_name")


@entry(book, "txt_similar_pairs", EMBED_SQL + """, q AS (SELECT l.text AS a, r.text AS b, sum(l.weight * r.weight) AS cos
 FROM e l JOIN e r ON l.gram = r.gram AND l.text < r.text GROUP BY 1, 2) SELECT a, b, cos FROM q WHERE cos >= 0.4""", "cos", 8)
def _(t):
    return k.similar_pairs(k.txt_embed(t("part"), "p_name"))


@entry(book, "txt_cluster")
def _(t):
    return k.txt_cluster(k.txt_normalise(pages(t), "kw"), "keyword")


@entry(book, "txt_groups")
def _(t):
    return k.group_keywords(parts(t), "kw", facets())


def _approved(t) -> DataFrame:
    return t("part").select(F.col("p_name").alias("keyword"), F.split_part("p_name", F.lit(" "), F.lit(2))
                            .alias("group")).distinct()


@entry(book, "txt_carry_forward", EMBED_SQL.replace("SELECT DISTINCT p_name AS text FROM part",
                                                    "SELECT DISTINCT p_name AS text FROM part UNION SELECT DISTINCT lower(p_type) FROM part")
       + """, m AS (SELECT DISTINCT p_name AS text, split_part(p_name, ' ', 2) AS g FROM part),
 c AS (SELECT g, gram, sum(weight) AS s FROM m JOIN e USING (text) GROUP BY 1, 2),
 cn AS (SELECT g, gram, s / sqrt(sum(s * s) OVER (PARTITION BY g)) AS c FROM c),
 nk AS (SELECT DISTINCT p_name AS text FROM part UNION SELECT DISTINCT lower(p_type) FROM part),
 z AS (SELECT text, g, 1 - sum(weight * c) AS dist FROM nk JOIN e USING (text) JOIN cn USING (gram) GROUP BY 1, 2),
 b AS (SELECT text, min(dist) AS dist, arg_min(g, dist) AS g FROM z GROUP BY 1)
SELECT text AS keyword, g AS "group", dist AS distance FROM b WHERE dist <= 0.6""", "distance", 3)
def _(t):
    new = t("part").select(F.col("p_name").alias("keyword")).unionByName(
        t("part").select(F.lower("p_type").alias("keyword"))).distinct()
    return k.txt_carry_forward(new, _approved(t), facets=facets())


@entry(book, "txt_score", """
WITH g AS (SELECT doc_id, source AS group_id, lang AS class FROM documents),
 c AS (SELECT group_id, class, count(*) AS n FROM g GROUP BY 1, 2), t AS (SELECT sum(n) AS n FROM c)
SELECT (SELECT sum(m) FROM (SELECT max(n) AS m FROM c GROUP BY group_id)) / n AS purity,
 (SELECT sum(m) FROM (SELECT max(n) AS m FROM c GROUP BY class)) / n AS completeness,
 (SELECT count(DISTINCT group_id) FROM c) AS groups, (SELECT count(DISTINCT class) FROM c) AS classes,
 CAST(n AS BIGINT) AS keywords FROM t""", "purity completeness", 6)
def _(t):
    d = t("documents").select(F.col("doc_id").cast("string").alias("keyword"), F.col("source").alias("group_id"), "lang")
    return k.txt_score(d.select("keyword", "group_id"), d.select("keyword", F.col("lang").alias("class")))


@entry(book, "txt_group_edit", """
WITH g AS (SELECT DISTINCT p_name AS keyword, split_part(p_name, ' ', 2) AS group_id FROM part),
 r AS (SELECT *, row_number() OVER (ORDER BY group_id) AS r FROM (SELECT DISTINCT group_id FROM g)),
 a AS (SELECT (SELECT group_id FROM r WHERE r = 1) AS g1, (SELECT group_id FROM r WHERE r = 2) AS g2,
  (SELECT group_id FROM r WHERE r = 3) AS g3, (SELECT group_id FROM r WHERE r = 4) AS g4,
  (SELECT min(keyword) FROM g WHERE group_id = (SELECT group_id FROM r WHERE r = 3)) AS k3,
  (SELECT min(keyword) FROM g WHERE group_id = (SELECT group_id FROM r WHERE r = 4)) AS k4),
 m AS (SELECT keyword, group_id AS was, CASE WHEN group_id = g1 THEN g2 WHEN keyword = k3 AND group_id = g3 THEN g4
  WHEN keyword = k4 AND group_id = g4 THEN 'new' ELSE group_id END AS group_id FROM g, a)
SELECT keyword, group_id, CASE WHEN group_id = 'new' THEN was || ' (split)' WHEN group_id = g2 THEN 'renamed' ELSE group_id END AS label,
 group_id = g4 AS approved FROM m, a""")
def _(t):
    g = t("part").select(F.col("p_name").alias("keyword"), F.split_part("p_name", F.lit(" "), F.lit(2))
                         .alias("group_id")).distinct().withColumns({"label": F.col("group_id"),
                                                                    "approved": F.lit(False)})
    firsts = g.groupBy("group_id").agg(F.min("keyword").alias("kw")).orderBy("group_id").limit(4)
    ids = [(r["group_id"], r["kw"]) for r in firsts.collect()]      # four edits' worth of names
    (g1, _), (g2, _), (g3, k3), (g4, k4) = ids
    rows = [("merge", g1, None, g2, None), ("rename", g2, None, None, "renamed"), ("move", g3, k3, g4, None),
            ("split", g4, k4, "new", None), ("approve", g4, None, None, None)]
    edits = g.sparkSession.createDataFrame(rows, "action string, group_id string, keyword string, target string, label string")
    return k.txt_group_edit(g, edits)
