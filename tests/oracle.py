"""Runs catalogue queries against DuckDB on the same parquet files; also usable as a script."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return "d" + v.isoformat()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(df, con, sql):
    """None when equal, else a short description of the difference."""
    got_names = df.columns
    got = rows_of(got_names, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(got_names) != sorted(names):
        return f"columns {sorted(got_names)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. {got[:2]} / {want[:2]}"
    if not got:
        return "EMPTY on both sides"
    for a, b in zip(got, want):
        if a != b:
            return f"{sorted(names)}\n   got  {a}\n   want {b}"
    return None


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").appName("checks")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.shuffle.partitions", "8").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), connect(sf)
    queries, oracles = e.queries(), e.oracle_sql()
    names = [n for n in queries if not argv or any(a in n for a in argv)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = queries[n](spark, sf)
            if n in oracles:
                diff = compare(df, con, oracles[n])
            else:
                diff = None if df.count() >= 0 else "?"
        except Exception as ex:
            diff = f"{type(ex).__name__}: {str(ex)[:600]}"
        status = "ok  " if diff is None else "FAIL"
        bad += diff is not None
        print(f"{status} {n} {time.time() - t:.1f}s {'' if n in oracles else '(no sql)'}"
              + (f"\n   {diff}" if diff else ""), flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
