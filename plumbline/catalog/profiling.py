"""Profiling, keys, drift and measure suggestions (sections 2.10 to 2.12)."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import keys as k
from ..operators import profile as p
from ..operators import suggest as s
from .base import entry
from .planted import DIRTY_SQL, FAULTY_SQL, TEXTS_SQL, dirty, faulty, texts

book: dict = {}

LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _each(columns, one, f):
    return " UNION ALL ".join(one.format(c=c, i=i, f=f) for i, c in enumerate(columns))


@entry(book, "prof_columns", _each(LINE_COLUMNS, """SELECT '{c}' AS "column", {i} AS position,
 count(*) AS "rows", count({c}) AS non_null, min({c})::VARCHAR AS low, max({c})::VARCHAR AS high,
 count(DISTINCT {c}) AS "distinct" FROM {f}""", "lineitem"))
def _(t):
    return p.prof_columns(t("lineitem"))


NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@entry(book, "prof_numeric", _each(NUMS, """SELECT '{c}' AS "column", avg({c}) AS mean,
 stddev_samp({c}) AS sd, quantile_cont({c}, 0.25) AS q1, median({c}) AS median, quantile_cont({c}, 0.75) AS q3,
 0::BIGINT AS non_finite FROM {f}""", "lineitem"), "mean sd q1 median q3")
def _(t):
    return p.prof_numeric(t("lineitem"), NUMS)


@entry(book, "prof_text", _each(["priority", "status", "text_day"], """SELECT '{c}' AS "column",
 count(*) FILTER (WHERE trim({c}) = '') AS blank, count(*) FILTER (WHERE upper(trim({c})) IN ('N/A', 'NA', 'NULL', 'NAN'))
 AS missing FROM {f}""", DIRTY_SQL))
def _(t):
    return p.prof_text(dirty(t), ["priority", "status", "text_day"])


@entry(book, "prof_missing_tokens", f"""SELECT 'priority' AS "column", trim(priority) AS token,
 count(*) AS "rows" FROM {DIRTY_SQL} WHERE upper(trim(priority)) = 'N/A' GROUP BY 2""")
def _(t):
    return p.prof_missing_tokens(dirty(t), ["priority", "status"])


READ = """SELECT '{c}' AS "column", count(*) AS considered,
 count(*) FILTER (WHERE TRY_CAST({c} AS DOUBLE) = floor(TRY_CAST({c} AS DOUBLE))) AS bigint,
 count(TRY_CAST({c} AS DOUBLE)) AS double,
 count(*) FILTER (WHERE TRY_CAST({c} AS TIMESTAMP) = TRY_CAST(TRY_CAST({c} AS DATE) AS TIMESTAMP)) AS date,
 count(TRY_CAST({c} AS TIMESTAMP)) AS timestamp,
 count(*) FILTER (WHERE lower(trim({c})) IN ('true', 'false', 't', 'f', '0', '1')) AS boolean,
 count(*) FILTER (WHERE regexp_matches({c}, '^[+-]?0[0-9]')) AS leading_zero,
 count(*) FILTER (WHERE regexp_matches({c}, '[₹$€£¥,]') AND
  TRY_CAST(regexp_replace({c}, '[₹$€£¥,\\s]', '', 'g') AS DOUBLE) IS NOT NULL) AS currency
 FROM {f} WHERE {c} IS NOT NULL AND trim({c}) <> '' AND upper(trim({c})) <> 'N/A'"""
READ_COLUMNS = ["code", "price", "stamp", "flag", "money", "label"]


@entry(book, "prof_type_reading", "WITH r AS (" + _each(READ_COLUMNS, READ, TEXTS_SQL) + """),
 g AS (SELECT *, greatest(bigint, double, date, timestamp, boolean) AS top FROM r)
SELECT * EXCLUDE (top), CASE WHEN top = 0 THEN NULL WHEN bigint = top THEN 'bigint' WHEN double = top THEN 'double'
 WHEN date = top THEN 'date' WHEN timestamp = top THEN 'timestamp' ELSE 'boolean' END AS best,
 top / considered AS ratio FROM g""", "ratio", 6)
def _(t):
    return p.prof_type_reading(texts(t), READ_COLUMNS)


@entry(book, "prof_unread_examples", f"""SELECT DISTINCT price AS value FROM {TEXTS_SQL}
 WHERE TRY_CAST(price AS DOUBLE) IS NULL ORDER BY 1 LIMIT 3""")
def _(t):
    return p.unread_examples(texts(t), "price", "double")


@entry(book, "prof_outliers", _each(["l_quantity", "l_extendedprice", "l_tax"], """SELECT '{c}' AS "column",
 q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper,
 (SELECT count(*) FROM {f} WHERE {c} < q1 - 1.5 * (q3 - q1)) AS below,
 (SELECT count(*) FROM {f} WHERE {c} > q3 + 1.5 * (q3 - q1)) AS above FROM (SELECT quantile_cont({c}, 0.25) AS q1,
 quantile_cont({c}, 0.75) AS q3 FROM {f})""", "lineitem"), "lower upper", 6)
def _(t):
    return p.prof_outliers(t("lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


DUPED_SQL = "(SELECT l_orderkey, l_returnflag, l_linestatus, l_discount FROM lineitem)"


@entry(book, "prof_duplicates", f"""SELECT (SELECT count(*) FROM {DUPED_SQL}) AS "rows",
 (SELECT count(*) FROM (SELECT DISTINCT * FROM {DUPED_SQL})) AS distinct_rows,
 (SELECT count(*) FROM {DUPED_SQL}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DUPED_SQL})) AS duplicates""")
def _(t):
    return p.prof_duplicates(t("lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_discount"))


@entry(book, "prof_top_values", """SELECT p_brand AS value, count(*) AS "rows", count(*) / (SELECT count(*) FROM part)
 AS share FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""", "share", 6)
def _(t):
    return p.prof_top_values(t("part"), "p_brand", 5)


@entry(book, "prof_histogram", """
WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
 m AS (SELECT lo, hi, pow(10, floor(log10((hi - lo) / 10))) AS pw, (hi - lo) / 10 AS raw FROM b),
 s AS (SELECT lo, hi, CASE WHEN pw >= raw THEN pw WHEN 2 * pw >= raw THEN 2 * pw WHEN 5 * pw >= raw THEN 5 * pw
  ELSE 10 * pw END AS step FROM m),
 k AS (SELECT unnest(range(ceil(lo / step)::BIGINT, ceil(hi / step)::BIGINT + 1)) AS k, step FROM s),
 c AS (SELECT ceil(o_totalprice / (SELECT step FROM s))::BIGINT AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT (k.k - 1) * step AS lo, k.k * step AS hi, coalesce(n, 0) AS "rows" FROM k LEFT JOIN c USING (k)""",
       "lo hi", 4)
def _(t):
    return p.prof_histogram(t("orders"), "o_totalprice", 10)


@entry(book, "prof_lengths", _each(["o_orderstatus", "o_orderpriority"], """SELECT '{c}' AS "column",
 min(length({c}))::INT AS shortest, max(length({c}))::INT AS longest, avg(length({c})) AS mean,
 min(length({c})) = max(length({c})) AS fixed_width FROM {f}""", "orders"), "mean")
def _(t):
    return p.prof_lengths(t("orders"))


@entry(book, "prof_date_coverage", """
WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE o_totalprice > 400000),
 s AS (SELECT min(d) AS lo, max(d) AS hi, count(*) AS n FROM d),
 a AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS d FROM s),
 g AS (SELECT d - row_number() OVER (ORDER BY d)::INT AS k FROM a WHERE d NOT IN (SELECT d FROM d))
SELECT lo AS first, hi AS last, (SELECT count(*) FROM a) AS days_in_span, n AS present,
 (SELECT count(*) FROM g) AS missing, coalesce((SELECT max(c) FROM (SELECT count(*) AS c FROM g GROUP BY k)), 0)
 AS longest_gap FROM s""")
def _(t):
    dated = F.when(F.col("o_totalprice") > 400000, F.col("o_orderdate"))
    return p.prof_date_coverage(t("orders").withColumn("o_orderdate", dated), "o_orderdate")


ROLE = ("SELECT '{c}' AS \"column\", {role} AS role, count(DISTINCT {c}) AS \"distinct\", count(*) AS \"rows\" FROM lineitem")
FEW = "CASE WHEN count(DISTINCT {c}) <= 12 THEN 'dimension' ELSE 'measure' END"
ROLES = {"l_shipdate": "'date'", "l_returnflag": "'dimension'", "l_linestatus": "'dimension'",
         **{c: "'measure'" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}}


@entry(book, "prof_roles", " UNION ALL ".join(
    ROLE.format(c=c, role=ROLES.get(c, FEW.format(c=c))) for c in LINE_COLUMNS))
def _(t):
    return p.prof_roles(t("lineitem"))


@entry(book, "key_candidates", """
WITH n AS (SELECT count(*) AS n, count(DISTINCT event_id) AS d FROM events)
SELECT 'event_id' AS columns, d AS "distinct", n AS "rows", '' AS null_bearing, false AS caution FROM n WHERE d = n
UNION ALL SELECT 'ts', (SELECT count(DISTINCT ts) FROM events), n, '', false FROM n
 WHERE (SELECT count(DISTINCT ts) FROM events) = n""")
def _(t):
    return k.key_candidates(t("events"))


@entry(book, "key_candidates_pairs", """
WITH c AS (SELECT conv_id, turn, role FROM conversations)
SELECT a || ',' || b AS columns, d AS "distinct", n AS "rows", '' AS null_bearing, true AS caution FROM (
 SELECT 'conv_id' AS a, 'turn' AS b, (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM c)) AS d,
 (SELECT count(*) FROM c) AS n) WHERE d = n""")
def _(t):
    return k.key_candidates(t("conversations").select("conv_id", F.col("turn"), "role"))


VERIFY = """
WITH f AS (SELECT * FROM {f}), c AS (SELECT * FROM f WHERE {keyed}),
 d AS (SELECT (SELECT count(*) FROM f) AS n, (SELECT count(*) FROM f WHERE {null}) AS nulls, (SELECT count(*) FROM c) AS m,
 (SELECT count(*) FROM (SELECT DISTINCT {key} FROM c)) AS k, (SELECT count(*) FROM (SELECT DISTINCT * FROM c)) AS w)
SELECT n AS "rows", nulls AS null_rows, m AS comparable, k AS "distinct", m - k AS duplicates, m - w AS exact_copies,
 m = k AND nulls = 0 AS holds FROM d"""


@entry(book, "key_verify", VERIFY.format(f=FAULTY_SQL, keyed="order_id IS NOT NULL", null="order_id IS NULL",
                                         key="order_id"))
def _(t):
    return k.key_verify(faulty(t), ["order_id"])


@entry(book, "key_verify_composite", VERIFY.format(
    f=FAULTY_SQL, keyed="true", null="order_id IS NULL OR part IS NULL", key="order_id, part"))
def _(t):
    return k.key_verify(faulty(t), ["order_id", "part"])


@entry(book, "key_nearest", f"""
WITH c AS (SELECT * FROM {FAULTY_SQL} WHERE order_id IS NOT NULL)
SELECT 'order_id' AS "column", (SELECT count(*) - count(DISTINCT order_id) FROM c) AS duplicates,
 (SELECT count(*) FROM {FAULTY_SQL} WHERE order_id IS NULL) AS null_rows,
 (SELECT count(*) FROM c) - (SELECT count(*) FROM (SELECT DISTINCT * FROM c)) AS exact_copies,
 false AS unique_without_copies""")
def _(t):
    return k.key_nearest(faulty(t))


PER_SQL = ("(SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_quantity AS quantity, o_totalprice AS order_total, "
           "o_custkey AS customer_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")


def _per_lines(t):
    l = t("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
                             F.col("l_quantity").alias("quantity"))
    o = t("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("order_total"),
                           F.col("o_custkey").alias("customer_id"))
    return l.join(o, "order_id")


@entry(book, "per_unit_find", f"""
WITH v AS (SELECT count(*) FILTER (WHERE lo <> hi) AS bad, count(*) AS n FROM (
 SELECT min(order_total) AS lo, max(order_total) AS hi FROM {PER_SQL} GROUP BY order_id))
SELECT 'order_total' AS measure, CASE WHEN bad = 0 THEN 'order_id' END AS unit, CASE WHEN bad = 0 THEN n END AS units FROM v
UNION ALL SELECT 'quantity', NULL, NULL""")
def _(t):
    return k.per_unit_find(_per_lines(t), ["order_total", "quantity"])


@entry(book, "drift_schema", """
SELECT * FROM (SELECT 'o_orderdate' AS "column", 'retyped' AS change, true AS used, 'timestamp_ntz' AS was, 'date' AS now
 UNION ALL SELECT 'o_totalprice', 'removed', true, 'double', NULL UNION ALL SELECT 'o_channel', 'added', false, NULL, 'string'
 UNION ALL SELECT '(table)', 'rows', false, (SELECT count(*)::VARCHAR FROM orders), (SELECT count(*)::VARCHAR FROM orders
 WHERE o_orderstatus <> 'P')), (SELECT 'DESTRUCTIVE' AS verdict)""")
def _(t):
    from .base import ORDERS
    was = t("orders")
    now = was.where("o_orderstatus <> 'P'").drop("o_totalprice").withColumn(
        "o_orderdate", F.col("o_orderdate").cast("date")).withColumn("o_channel", F.lit("web"))
    return k.drift_schema(was, now, ORDERS)


@entry(book, "fp_snapshot", """SELECT name, n AS "rows", true AS same FROM (
 SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer)""")
def _(t):
    from ..sources.results import snapshot
    parts = []
    for name in ("orders", "customer"):
        df = t(name)
        again = snapshot(df.repartition(3))
        parts.append(snapshot(df).select(F.lit(name).alias("name"), "rows", (
            F.col("fingerprint") == again.select("fingerprint").scalar()).alias("same")))
    return parts[0].unionByName(parts[1])


@entry(book, "stale_results", """
SELECT 'trend' AS result, false AS stale, '' AS reason, count(*) AS "rows" FROM orders UNION ALL
SELECT 'top_n', true, 'data', count(*) FROM orders UNION ALL SELECT 'pareto', true, 'contract', count(*) FROM orders""")
def _(t):
    from ..sources.results import snapshot, stale
    now = snapshot(t("orders"))
    older = snapshot(t("orders").where("o_orderstatus <> 'P'"))

    def stored(name, snap, version):
        return snap.select(F.lit(name).alias("result"), F.lit("orders").alias("dataset"), "fingerprint",
                           F.lit(version).alias("contract_version"), F.lit("m1").alias("metric_version"))

    log = stored("trend", now, 2).unionByName(stored("top_n", older, 2)).unionByName(stored("pareto", now, 1))
    state = now.select(F.lit("orders").alias("dataset"), "fingerprint", "rows",
                       F.lit(2).alias("contract_version"), F.lit("m1").alias("metric_version"))
    return stale(log, state).select("result", "stale", "reason", "rows")


@entry(book, "domain_values", """SELECT * FROM (
 SELECT 'o_orderstatus' AS "column", string_agg(DISTINCT o_orderstatus, ' | ' ORDER BY o_orderstatus) AS "values",
 count(DISTINCT o_orderstatus) AS "distinct" FROM orders UNION ALL SELECT 'o_orderpriority',
 string_agg(DISTINCT o_orderpriority, ' | ' ORDER BY o_orderpriority), count(DISTINCT o_orderpriority) FROM orders)""")
def _(t):
    return k.domain_values(t("orders"))


@entry(book, "date_column_pick", f"""
SELECT 'order_date' AS "column", true AS guess, CAST(max(order_date) - min(order_date) AS INT) AS span_days
FROM {DIRTY_SQL}""")
def _(t):
    return k.date_column_pick(dirty(t))


TABLES = ("orders", "lineitem", "customer", "supplier", "part", "events")


def _catalogue(t) -> DataFrame:
    """(dataset, column, non_null) measured from the tables themselves."""
    return reduce(DataFrame.unionByName, [p._wide(t(n), p.countable(t(n))).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("dataset"), F.lit(c).alias("column"), F.col(f"n{i}").alias("non_null"))
        for i, c in enumerate(p.countable(t(n)))]))) for n in TABLES])


HINTS = (("order_id", "orderkey"), ("customer_id", "custkey"), ("money", "totalprice"), ("money", "extendedprice"),
         ("money", "acctbal"), ("money", "retailprice"), ("date", "orderdate"), ("date", "shipdate"), ("date", "ts"),
         ("discount", "discount"), ("name", "name"), ("status", "linestatus"), ("status", "orderstatus"))


def _rows(spark, names, rows):
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[
        F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])))


HINT_SQL = ", ".join(f"('{c}', '{h}')" for c, h in HINTS)
CAT_SQL = " UNION ALL ".join(f"SELECT '{d}' AS dataset, '{c}' AS \"column\", count({c}) AS non_null FROM {d}"
                             for d, cols in (("orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"),
                                             ("lineitem", " ".join(LINE_COLUMNS)), ("customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment"),
                                             ("supplier", "s_suppkey s_name s_nationkey s_acctbal"),
                                             ("part", "p_partkey p_name p_brand p_type p_size p_retailprice"),
                                             ("events", "event_id ts user_id event_type value props")) for c in cols.split())


@entry(book, "concept_bind", f"""
WITH cat AS ({CAT_SQL}), h(concept, hint) AS (VALUES {HINT_SQL}),
 m AS (SELECT dataset, "column", concept, non_null, max(CASE WHEN hint = "column" THEN 3 ELSE 1 END) AS strength
  FROM cat JOIN h ON list_contains(string_split("column", '_'), hint) GROUP BY 1, 2, 3, 4)
SELECT * FROM m""")
def _(t):
    cat = _catalogue(t)
    hints = _rows(cat.sparkSession, ("concept", "hint"), HINTS)
    return k.concept_bind(cat.drop("non_null"), hints).join(cat, ["dataset", "column"])


SOURCES = (("sales", "order_id", 1.0), ("sales", "money", 1.0), ("sales", "date", 0.5), ("sales", "customer_id", 0.5),
           ("directory", "name", 1.0), ("directory", "money", 0.5))


@entry(book, "concept_scores", f"""
WITH cat AS ({CAT_SQL}), h(concept, hint) AS (VALUES {HINT_SQL}),
 s(source, concept, weight) AS (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in SOURCES)}),
 m AS (SELECT DISTINCT dataset, concept FROM cat JOIN h ON list_contains(string_split("column", '_'), hint))
SELECT dataset, s.source, round(sum(weight)::DOUBLE / any_value(w)::DOUBLE, 3) AS score FROM m JOIN s USING (concept)
JOIN (SELECT source, sum(weight) AS w FROM s GROUP BY 1) x ON x.source = s.source GROUP BY 1, 2""", "score")
def _(t):
    cat = _catalogue(t)
    bound = k.concept_bind(cat.drop("non_null"), _rows(cat.sparkSession, ("concept", "hint"), HINTS))
    return k.source_scores(bound, _rows(cat.sparkSession, ("source", "concept", "weight"), SOURCES))


@entry(book, "similar_dataset", """
SELECT 'orders' AS a, 'orders_again' AS b, 6 / 7.0 AS similarity, (SELECT count(*) FROM orders) AS "rows" """,
       "similarity", 6)
def _(t):
    cat = _catalogue(t).drop("non_null")
    again = cat.where("dataset = 'orders'").select(F.lit("orders_again").alias("dataset"), "column")
    more = again.limit(1).select("dataset", F.lit("o_note").alias("column"))
    found = k.similar_dataset(cat.unionByName(again).unionByName(more), 0.8)
    return found.withColumn("rows", t("orders").agg(F.count("*")).scalar())


# every table thrice: as it is, under another name, and with one column more
SHAPES_SQL = f"""cat AS (SELECT dataset, lower("column") AS c FROM ({CAT_SQL})),
 three AS (SELECT * FROM cat UNION ALL SELECT dataset || '_again', c FROM cat UNION ALL SELECT dataset || '_more', c FROM cat
  UNION ALL SELECT DISTINCT dataset || '_more', 'note' FROM cat),
 sets AS (SELECT dataset, list_sort(list(DISTINCT c)) AS names FROM three GROUP BY 1),
 cls AS (SELECT names, min(dataset) AS class, count(*) AS datasets FROM sets GROUP BY 1)"""


def _thrice(t) -> DataFrame:
    cat = _catalogue(t).select("dataset", "column")
    named = lambda suffix: F.concat("dataset", F.lit(suffix)).alias("dataset")
    return cat.unionByName(cat.select(named("_again"), F.upper("column").alias("column"))).unionByName(
        cat.select(named("_more"), "column")).unionByName(cat.select(named("_more"), F.lit("note").alias("column")))


@entry(book, "similar_dataset_members", f"""
WITH {SHAPES_SQL} SELECT dataset, class, datasets, CAST(len(names) AS INT) AS "columns" FROM sets JOIN cls USING (names)""")
def _(t):
    return k.dataset_classes(_thrice(t))


@entry(book, "similar_dataset_classes", f"""
WITH {SHAPES_SQL}, p AS (SELECT a.class AS a, b.class AS b, a.datasets AS a_datasets, b.datasets AS b_datasets,
 len(list_intersect(a.names, b.names))::DOUBLE / len(list_distinct(list_concat(a.names, b.names))) AS similarity
 FROM cls a JOIN cls b ON a.class < b.class) SELECT * FROM p WHERE similarity >= 0.8""", "similarity", 6)
def _(t):
    return k.similar_classes(_thrice(t), 0.8)


CLAIMS = ["1,000 rows where net < 0", "priority is 'N/A' in 149 rows", "amount is blank in 5088 records",
          "0 duplicate rows", "some text without a count"]


@entry(book, "caveat_check", f"""
WITH m AS (SELECT count(*) FILTER (WHERE net < 0) AS a, count(*) FILTER (WHERE priority = 'N/A') AS b,
 count(*) FILTER (WHERE amount IS NULL) AS c FROM {DIRTY_SQL})
SELECT '1,000 rows where net < 0' AS claim, CASE WHEN a = 1000 THEN 'agrees' ELSE 'differs' END AS status,
 1000::BIGINT AS claimed, a AS measured FROM m
UNION ALL SELECT 'priority is ''N/A'' in 149 rows', CASE WHEN b = 0 THEN 'unchecked' WHEN b = 149 THEN 'agrees' ELSE 'differs' END, 149, nullif(b, 0) FROM m
UNION ALL SELECT 'amount is blank in 5088 records', CASE WHEN c = 5088 THEN 'agrees' ELSE 'differs' END, 5088, c FROM m
UNION ALL SELECT '0 duplicate rows', 'agrees', 0, 0 UNION ALL SELECT 'some text without a count', 'unchecked', NULL, NULL""")
def _(t):
    return k.caveat_check(dirty(t), CLAIMS)


@entry(book, "metric_propose", f"""
SELECT 'late' AS metric, count(*) AS "rows", count(*) FILTER (WHERE shipped_date IS NOT NULL AND order_date IS NOT NULL)
 AS judged, CAST(sum(CAST(shipped_date < order_date AS INT)) AS BIGINT) AS true_rows FROM {DIRTY_SQL}""")
def _(t):
    return k.metric_propose(dirty(t), "late", "shipped_date", "<", "order_date")


@entry(book, "draft_check", """
WITH u AS (SELECT count(*) = count(DISTINCT o_orderkey) AS ok FROM orders)
SELECT 'date_column' AS field, 'o_orderdate' AS drafted, 'o_orderdate' AS kept, 'agrees' AS status
UNION ALL SELECT 'primary_key', 'o_orderkey', CASE WHEN ok THEN 'o_orderkey' END, CASE WHEN ok THEN 'agrees' ELSE 'overruled' END FROM u
UNION ALL SELECT 'measures[o_totalprice].agg', 'sum', 'sum', 'unproven'
UNION ALL SELECT 'measures[o_orderstatus].agg', 'sum', NULL, 'blocked'
UNION ALL SELECT 'measures[o_ghost].agg', 'mean', NULL, 'blocked'""")
def _(t):
    return k.draft_check(t("orders"), {"date_column": "o_orderdate", "primary_key": ["o_orderkey"],
                                       "measures": {"o_totalprice": "sum", "o_orderstatus": "sum", "o_ghost": "mean"}})


SUGGEST_SQL = ("(SELECT l_orderkey AS order_id, l_linenumber AS zip_code, l_quantity AS quantity, "
               "l_extendedprice AS revenue, l_extendedprice / l_quantity AS unit_price, l_discount AS discount_pct, "
               "o_totalprice AS order_fee, CAST(l_returnflag = 'R' AS INT) AS returned, l_tax AS c7 FROM lineitem "
               "JOIN orders ON l_orderkey = o_orderkey)")


def _suggest_table(t):
    l = t("lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("zip_code"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("revenue"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.col("l_discount").alias("discount_pct"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"), F.col("l_tax").alias("c7"))
    o = t("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("order_fee"))
    return l.join(o, "order_id")


@entry(book, "suggest_agg", f"""
SELECT *, CASE WHEN rule = 'R1' THEN 'revenue' END AS numerator, CASE WHEN rule = 'R1' THEN 'quantity' END AS denominator,
 CASE WHEN rule = 'R1' THEN 1.0::DOUBLE END AS scale FROM (
WITH u AS (SELECT count(*) FILTER (WHERE lo <> hi) AS bad FROM (SELECT min(order_fee) AS lo, max(order_fee) AS hi
 FROM {SUGGEST_SQL} GROUP BY order_id)), f AS (SELECT count(*) AS n, count(*) FILTER (WHERE
 abs(unit_price - revenue / quantity) <= 0.00006 + 1e-4 * abs(revenue / quantity)) AS hit FROM {SUGGEST_SQL})
SELECT 'order_fee' AS measure, 'sum' AS agg, 'strong' AS strength, CASE WHEN bad = 0 THEN 'P1' END AS rule,
 'order_id' AS unit, NULL AS detail FROM u
UNION ALL SELECT 'unit_price', 'none', 'strong', CASE WHEN hit >= 0.98 * n THEN 'R1' END, NULL, 'revenue / quantity' FROM f
UNION ALL SELECT * FROM (VALUES ('quantity', 'sum', 'strong', 'A1', NULL, NULL), ('revenue', 'sum', 'strong', 'A1', NULL, NULL),
 ('discount_pct', 'none', 'strong', 'N2', NULL, NULL), ('returned', 'mean', 'strong', 'F1', NULL, NULL),
 ('zip_code', 'none', 'strong', 'N1', NULL, NULL), ('c7', 'none', 'likely', 'N3', NULL, NULL)))""")
def _(t):
    return s.suggest_agg(_suggest_table(t), ["order_fee", "unit_price", "quantity", "revenue", "discount_pct",
                                             "returned", "zip_code", "c7"])


@entry(book, "draft_review", f"""
WITH u AS (SELECT count(*) AS n, count(DISTINCT (order_id, zip_code)) AS d FROM {SUGGEST_SQL}),
 p AS (SELECT count(*) FILTER (WHERE f0 <> f1) AS fee, count(*) FILTER (WHERE q0 <> q1) AS quantity FROM (SELECT min(order_fee) AS f0,
 max(order_fee) AS f1, min(quantity) AS q0, max(quantity) AS q1 FROM {SUGGEST_SQL} GROUP BY order_id)),
 r AS (SELECT count(*) AS n, count(*) FILTER (WHERE abs(unit_price - revenue / quantity) <= 0.00006 + 1e-4 * abs(revenue / quantity)) AS hit
 FROM {SUGGEST_SQL}),
 f AS (SELECT min(returned) = 0 AND max(returned) = 1 AS returned, min(quantity) = 0 AND max(quantity) = 1 AS quantity FROM {SUGGEST_SQL})
SELECT 'primary_key' AS field, 'order_id,zip_code' AS drafted, CASE WHEN n = d THEN 'order_id,zip_code' END AS kept,
 CASE WHEN n = d THEN 'agrees' ELSE 'overruled' END AS status FROM u
UNION ALL SELECT 'measures[order_fee].agg', 'sum', 'sum', 'agrees'
UNION ALL SELECT 'measures[unit_price].agg', 'sum', CASE WHEN hit >= 0.98 * n THEN 'none' END, 'overruled' FROM r
UNION ALL SELECT 'measures[quantity].agg', 'sum', 'sum', 'agrees'
UNION ALL SELECT 'measures[order_id].agg', 'sum', 'count_distinct', 'overruled'
UNION ALL SELECT 'measures[quantity].per', 'order_id', CASE WHEN quantity = 0 THEN 'order_id' END, CASE WHEN quantity = 0 THEN 'agrees' ELSE 'overruled' END FROM p
UNION ALL SELECT 'measures[order_fee].per', NULL, CASE WHEN fee = 0 THEN 'order_id' END, 'found' FROM p
UNION ALL SELECT 'measures[unit_price].ratio', NULL, CASE WHEN hit >= 0.98 * n THEN 'revenue / quantity' END, 'found' FROM r
UNION ALL SELECT 'measures[return_rate].flag', 'returned', CASE WHEN returned THEN 'returned' END, CASE WHEN returned THEN 'agrees' ELSE 'overruled' END FROM f
UNION ALL SELECT 'measures[bulk_rate].flag', 'quantity', CASE WHEN quantity THEN 'quantity' END, CASE WHEN quantity THEN 'agrees' ELSE 'overruled' END FROM f""")
def _(t):
    return k.draft_review(_suggest_table(t), {
        "primary_key": ["order_id", "zip_code"], "units": {"quantity": "order_id"}, "flags": {"return_rate": "returned", "bulk_rate": "quantity"},
        "measures": {"order_fee": "sum", "unit_price": "sum", "quantity": "sum", "order_id": "sum"}})
