"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated names), BENCH_RUNS
(default 2: the faster run counts, so that compilation is not measured).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from plumbline.catalog import all_queries

HEADLINE = [
    # the operations the baseline gives timings for
    "prof_columns", "prof_numeric", "prof_type_reading", "prof_duplicates", "key_candidates", "key_verify",
    "suggest_agg", "cln_detect", "val_report", "dq_blank",
    # analyses
    "scope_counts", "summary_stats", "top_n", "group_compare", "cross_tab", "distribution", "pareto",
    "trend", "trend_split", "seasonality", "growth_decomposition", "mix_shift", "correlation", "bivariate",
    "driver_analysis", "outlier_within", "changepoint", "hypothesis_test", "hypothesis_test_kruskal",
    "cohort_retention", "repeat_gaps", "funnel", "unit_economics", "key_overlap", "text_ngrams",
    "text_ngrams_2", "txt_embed", "txt_carry_forward", "preset_channel_efficiency", "src_csv", "snk_result",
]


def session(cpus: str) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    queries = all_queries()
    spark = session(cpus)
    times, failed = {}, {}
    for name in names:
        best = None
        try:
            for _ in range(runs):
                start = time.perf_counter()
                queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                took = time.perf_counter() - start
                best = took if best is None else min(best, took)
            times[name] = round(best, 3)
        except Exception as exc:  # a failed query must not hide the others' times
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
        print(f"{name} {times.get(name, failed.get(name))}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
