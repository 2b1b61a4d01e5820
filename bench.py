"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query's full plan is executed into Spark's ``noop`` sink (nothing is
collected to the driver), after one small warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabsmith.plans.registry import QUERIES, load_all  # noqa: E402
from tabsmith.session import local_session  # noqa: E402

HEADLINE = [
    "qa_report_lineitem",
    "table_profile",
    "stratified_kfold_lineitem",
    "stratified_subsample",
    "feature_plan_lineitem",
    "qa_report",
    "stratified_kfold",
    "kfold",
    "time_split",
    "feature_plan",
    "frequency_encode",
    "tfidf_vocab",
    "first_per_context",
    "terminal_guard",
    "evaluate_regression",
]
# input table of each query, for rows/s
INPUT = {
    "qa_report_lineitem": "lineitem", "table_profile": "lineitem", "stratified_kfold_lineitem": "lineitem",
    "stratified_subsample": "lineitem", "feature_plan_lineitem": "lineitem", "kfold": "lineitem",
    "qa_report": "orders", "stratified_kfold": "orders", "evaluate_regression": "orders",
    "time_split": "events", "feature_plan": "events", "frequency_encode": "events",
    "first_per_context": "events", "terminal_guard": "events", "tfidf_vocab": "documents",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    load_all()
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app="tabsmith-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # warm-up, not timed
    sizes = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in sorted({INPUT.get(n, "") for n in names} - {""})}
    times: dict[str, float] = {}
    rows_per_sec: dict[str, int] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        if name in INPUT:
            rows_per_sec[name] = int(sizes[INPUT[name]] / max(times[name], 1e-9))
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "rows_per_sec": rows_per_sec, "input_rows": sizes,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
