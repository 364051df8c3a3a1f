"""Cleaning actions (section 2.15), on text columns with planted reading problems."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean as c
from ..operators.clean import Action
from ..sources import results, versions
from .base import entry
from .planted import TEXTS_SQL, texts

book: dict = {}

NA = "upper(trim({c})) IN ('N/A', 'NA', 'NULL', 'NAN')"


@entry(book, "cln_convert_type", f"""
SELECT o_orderkey, TRY_CAST(CASE WHEN TRY_CAST(code AS DOUBLE) = floor(TRY_CAST(code AS DOUBLE)) THEN code END AS BIGINT) AS code,
 CAST(TRY_CAST(price AS DECIMAL(18, 2)) AS DOUBLE) AS price, TRY_CAST(stamp AS TIMESTAMP) AS stamp, flag = 'true' AS flag FROM {TEXTS_SQL}""",
       "price", 2)
def _(t):
    df = c.cln_apply(texts(t).select("o_orderkey", "code", "price", "stamp", "flag"), [
        Action("convert_type", "code", {"to": "bigint"}), Action("convert_type", "price", {"to": "decimal(18,2)"}),
        Action("convert_type", "stamp", {"to": "timestamp"}), Action("convert_type", "flag", {"to": "boolean"})])
    return df.withColumn("price", F.col("price").cast("double"))


def _impact(df, *actions) -> DataFrame:
    out = None
    for a in actions:
        one = c.impact(df, a).select("kind", "column", "affected", "lost")
        out = one if out is None else out.unionByName(one)
    return out


@entry(book, "cln_lost", f"""
SELECT 'convert_type' AS kind, 'code' AS "column", count(code) AS affected, count(*) FILTER (WHERE NOT {NA.format(c='code')} AND
 (TRY_CAST(code AS BIGINT) IS NULL OR regexp_matches(code, '^0[0-9]'))) AS lost FROM {TEXTS_SQL} UNION ALL
SELECT 'convert_type', 'price', count(price), count(*) FILTER (WHERE TRY_CAST(price AS DOUBLE) IS NULL OR regexp_matches(price, '^0[0-9]')) FROM {TEXTS_SQL}
UNION ALL SELECT 'convert_type', 'stamp', count(stamp), count(*) FILTER (WHERE TRY_CAST(stamp AS TIMESTAMP) IS NULL) FROM {TEXTS_SQL}""")
def _(t):
    return _impact(texts(t), Action("convert_type", "code", {"to": "bigint"}),
                   Action("convert_type", "price", {"to": "decimal(18,2)"}), Action("convert_type", "stamp", {"to": "timestamp"}))


@entry(book, "cln_currency", f"""
SELECT o_orderkey, CAST(regexp_replace(money, '[₹$€£¥,\\s]', '', 'g') AS DOUBLE) AS money FROM {TEXTS_SQL}""", "money", 2)
def _(t):
    return c.apply_one(texts(t).select("o_orderkey", "money"), Action(
        "convert_type", "money", {"to": "decimal(18,2)", "reading": "currency"})).withColumn(
        "money", F.col("money").cast("double"))


@entry(book, "cln_number_locale", f"""
WITH d AS (SELECT o_orderkey, CASE WHEN regexp_matches(eu, '^\\(.*\\)$') THEN '-' || trim(eu, '()') ELSE eu END AS eu, pct FROM {TEXTS_SQL})
SELECT o_orderkey, CAST(replace(replace(eu, '.', ''), ',', '.') AS DOUBLE) AS eu, CAST(replace(rtrim(pct, '%'), ',', '.') AS DOUBLE) AS pct
FROM d""", "eu pct", 2)
def _(t):
    return c.cln_apply(texts(t).select("o_orderkey", "eu", "pct"), [
        Action("convert_type", "eu", {"to": "double", "reading": "eu"}),
        Action("convert_type", "pct", {"to": "double", "reading": "percent"})])


@entry(book, "cln_dates_multi", f"""
SELECT o_orderkey, coalesce(TRY_STRPTIME(mixed_day, '%d/%m/%Y'), TRY_STRPTIME(mixed_day, '%Y-%m-%d'))::DATE AS mixed_day FROM {TEXTS_SQL}""")
def _(t):
    return c.apply_one(texts(t).select("o_orderkey", "mixed_day"), Action(
        "convert_type", "mixed_day", {"to": "date", "reading": "dates", "order": "day"}))


@entry(book, "cln_two_digit_years", """
SELECT o_orderkey, strptime(strftime(o_orderdate, '%d/%m/%y'), '%d/%m/%y')::DATE AS late,
 (CASE WHEN o_orderkey % 2 = 0 THEN DATE '1969-12-31' ELSE DATE '2068-01-05' END) AS pivot FROM orders""")
def _(t):
    df = t("orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yy").alias("late"), F.when(
        F.col("o_orderkey") % 2 == 0, "31/12/69").otherwise("05/01/68").alias("pivot"))
    o = {"to": "date", "reading": "dates", "order": "day"}
    return c.cln_apply(df, [Action("convert_type", "late", o), Action("convert_type", "pivot", o)])


@entry(book, "cln_missing", f"""
SELECT code, count(*) AS n FROM (SELECT CASE WHEN {NA.format(c='code')} THEN NULL ELSE code END AS code FROM {TEXTS_SQL}) GROUP BY 1""")
def _(t):
    return c.apply_one(texts(t), Action("normalise_missing", "code")).groupBy("code").agg(F.count("*").alias("n"))


@entry(book, "cln_trim", f"""SELECT trim(label) AS label, count(*) AS n FROM {TEXTS_SQL} GROUP BY 1""")
def _(t):
    return c.apply_one(texts(t), Action("trim", "label")).groupBy("label").agg(F.count("*").alias("n"))


@entry(book, "cln_case", f"""
WITH d AS (SELECT label, upper(label) AS up FROM {TEXTS_SQL})
SELECT 'case' AS kind, 'label' AS "column", count(*) FILTER (WHERE label <> up) AS affected,
 count(DISTINCT label) - count(DISTINCT up) AS lost FROM d""")
def _(t):
    return _impact(texts(t), Action("case", "label", {"mode": "upper"}))


@entry(book, "cln_dedupe", """
SELECT l_returnflag, l_linestatus, l_discount, l_tax, l_quantity, count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_discount, l_tax,
 l_quantity FROM lineitem) GROUP BY ALL""", "l_discount l_tax l_quantity")
def _(t):
    df = t("lineitem").select("l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_quantity")
    return c.apply_one(df, Action("drop_duplicates")).groupBy(*df.columns).agg(F.count("*").alias("n"))


@entry(book, "cln_dedupe_sample", """
SELECT '{"a":"' || l_returnflag || '","b":"' || l_linestatus || '","copies":' || count(*) || '}' AS value FROM lineitem
GROUP BY l_returnflag, l_linestatus HAVING count(*) > 1 ORDER BY 1 LIMIT 5""")
def _(t):
    df = t("lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"))
    return c.lost_sample(df, Action("drop_duplicates"))


@entry(book, "cln_non_finite", f"""
SELECT 'non_finite' AS kind, 'reading' AS "column", count(*) FILTER (WHERE NOT isfinite(reading)) AS affected,
 count(*) FILTER (WHERE NOT isfinite(reading)) AS lost FROM {TEXTS_SQL}""")
def _(t):
    return _impact(texts(t), Action("non_finite", "reading"))


@entry(book, "cln_header_rows", """SELECT count(*) AS n, min(n_name) AS first FROM nation""")
def _(t):
    n = t("nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name",
                           F.col("n_regionkey").cast("string").alias("n_regionkey"))
    # every region also repeats the header row once
    copy = t("region").select(F.lit("N_NATIONKEY").alias("n_nationkey"), F.lit("n name").alias("n_name"),
                              F.col("r_regionkey").cast("string").alias("n_regionkey"))
    return c.apply_one(n.unionByName(copy), Action("drop_header_rows")).agg(
        F.count("*").alias("n"), F.min("n_name").alias("first"))


@entry(book, "cln_exclude_column", """SELECT 'exclude_column' AS kind, 'l_tax' AS "column", count(*) AS affected, count(l_tax) AS lost FROM lineitem""")
def _(t):
    return _impact(t("lineitem"), Action("exclude_column", "l_tax"))




@entry(book, "cln_detect", f"""
WITH d AS (SELECT * FROM {TEXTS_SQL})
SELECT 'normalise_missing' AS kind, 'code' AS "column", '' AS options, count(*) FILTER (WHERE {NA.format(c='code')}) AS affected, 0::BIGINT AS lost FROM d
UNION ALL SELECT 'convert_type', 'price', 'to=decimal(18,2)', count(*), count(*) FILTER (WHERE TRY_CAST(price AS DOUBLE) IS NULL) FROM d
UNION ALL SELECT 'convert_type', 'stamp', 'to=timestamp', count(*), 0 FROM d
UNION ALL SELECT 'convert_type', 'flag', 'to=boolean', count(*), 0 FROM d
UNION ALL SELECT 'convert_type', 'money', 'reading=us, to=decimal(18,2)', count(*), count(*) FILTER (WHERE regexp_matches(trim(money), '^[+-]?0[0-9]')) FROM d
UNION ALL SELECT 'trim', 'label', '', count(*) FILTER (WHERE label <> trim(label)), 0 FROM d
UNION ALL SELECT 'case', 'label', 'mode=upper', count(*) FILTER (WHERE label <> upper(label)), count(DISTINCT label) - count(DISTINCT upper(label)) FROM d
UNION ALL SELECT 'convert_type', 'mixed_day', 'order=day, reading=dates, to=date', count(*), 0 FROM d
UNION ALL SELECT 'convert_type', 'pct', 'reading=percent, to=decimal(18,2)', count(*), count(*) FILTER (WHERE regexp_matches(pct, '^0[0-9]')) FROM d
UNION ALL SELECT 'convert_type', 'eu', 'reading=eu, to=decimal(18,2)', count(*), 0 FROM d
UNION ALL SELECT 'non_finite', 'reading', '', count(*) FILTER (WHERE NOT isfinite(reading)), count(*) FILTER (WHERE NOT isfinite(reading)) FROM d""")
def _(t):
    return c.cln_detect(texts(t)).drop("id")


STEPS = [Action("trim", "label"), Action("case", "label", {"mode": "upper"}), Action("convert_type", "price", {"to": "double"}),
         Action("exclude_column", "eu")]


@entry(book, "cln_apply", f"""
SELECT upper(trim(label)) AS label, count(*) AS n, sum(TRY_CAST(price AS DOUBLE)) AS price FROM {TEXTS_SQL} GROUP BY 1""", "price", 2)
def _(t):
    return c.cln_apply(texts(t), STEPS).groupBy("label").agg(F.count("*").alias("n"), F.sum("price").alias("price"))


@entry(book, "cln_ledger", f"""
WITH d AS (SELECT *, trim(label) AS tl FROM {TEXTS_SQL})
SELECT 1 AS step, 'trim' AS kind, 'label' AS "column", count(*) FILTER (WHERE label <> tl) AS affected, 0::BIGINT AS lost FROM d
UNION ALL SELECT 2, 'case', 'label', count(*) FILTER (WHERE tl <> upper(tl)), count(DISTINCT tl) - count(DISTINCT upper(tl)) FROM d
UNION ALL SELECT 3, 'convert_type', 'price', count(*), count(*) FILTER (WHERE TRY_CAST(price AS DOUBLE) IS NULL) FROM d
UNION ALL SELECT 4, 'exclude_column', 'eu', count(*), count(eu) FROM d""")
def _(t):
    return c.ledger(texts(t), STEPS).select("step", "kind", "column", "affected", "lost")


def _versioned(t) -> str:
    """The texts as version 1, cleaned as version 2, and back as version 3."""
    df = texts(t)
    path = results.scratch(df.sparkSession, "versions")
    versions.commit(df, path, "load")
    c.cln_apply_version(df.sparkSession, path, STEPS, note="plan")
    versions.undo(df.sparkSession, path)
    return path


@entry(book, "cln_apply_version", f"""
WITH d AS (SELECT * FROM {TEXTS_SQL})
SELECT 1::BIGINT AS version, 0::BIGINT AS parent, 'load' AS kind, count(*) AS "rows", count(DISTINCT label) AS labels, count(price) AS prices, count(eu) AS eus FROM d UNION ALL
SELECT 2, 1, 'clean', count(*), count(DISTINCT upper(trim(label))), count(TRY_CAST(price AS DOUBLE)), 0 FROM d UNION ALL
SELECT 3, 2, 'undo', count(*), count(DISTINCT label), count(price), count(eu) FROM d""")
def _(t):
    spark, path = t("region").sparkSession, _versioned(t)
    held = None
    for n in (1, 2, 3):
        df = versions.read(spark, path, n)
        eus = F.count("eu") if "eu" in df.columns else F.lit(0).cast("long")
        one = df.agg(F.lit(n).cast("long").alias("version"), F.count_distinct("label").alias("labels"), F.count("price").alias("prices"), eus.alias("eus"))
        held = one if held is None else held.unionByName(one)
    return versions.versions(spark, path).select("version", "parent", "kind", "rows").join(held, "version")


@entry(book, "cln_apply_ledger", f"""
WITH d AS (SELECT *, trim(label) AS tl FROM {TEXTS_SQL}), n AS (SELECT count(*) AS n FROM d)
SELECT 2::BIGINT AS version, step, kind, "column", affected, n AS rows_before, n AS rows_after FROM n, (
 SELECT 1 AS step, 'trim' AS kind, 'label' AS "column", count(*) FILTER (WHERE label <> tl) AS affected FROM d
 UNION ALL SELECT 2, 'case', 'label', count(*) FILTER (WHERE tl <> upper(tl)) FROM d
 UNION ALL SELECT 3, 'convert_type', 'price', count(*) FROM d UNION ALL SELECT 4, 'exclude_column', 'eu', count(*) FROM d)""")
def _(t):
    return versions.ledgers(t("region").sparkSession, _versioned(t)).select(
        "version", "step", "kind", "column", "affected", "rows_before", "rows_after")
