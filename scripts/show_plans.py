"""Write PLANS.md: condensed physical plans (exchanges, joins, windows, aggregates, scans) of headline queries.

    python scripts/show_plans.py [--sf-dir DIR] > PLANS.md
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = re.compile(r"(Exchange|BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoop|Window|HashAggregate|SortAggregate|"
                  r"ObjectHashAggregate|TakeOrderedAndProject|Generate|FileScan|MapInPandas|FlatMapGroupsInPandas|Union)")
HEADLINE = ["qa_report_lineitem", "table_profile", "stratified_kfold_lineitem", "stratified_subsample", "feature_plan_lineitem",
            "time_split", "tfidf_vocab", "terminal_guard", "frequency_encode", "impute_median"]


def condensed(plan: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        if KEEP.search(line):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"Location: InMemoryFileIndex\(1 paths\)\[file:[^\]]*/", "file:", line)
            out.append(line[:200])
    return out


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    args = ap.parse_args()
    from tabsmith.plans.registry import QUERIES, load_all
    from tabsmith.session import local_session

    load_all()
    spark = local_session(8, 16)
    print("# Physical plans of headline queries\n")
    print(f"Generated by `scripts/show_plans.py` at `{args.sf_dir}` (local[8], AQE on; initial plans, before AQE re-planning).\n")
    for name in HEADLINE:
        df = QUERIES[name](spark, args.sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"## {name}\n\n{QUERIES[name].__doc__.strip().splitlines()[0]}\n\n```")
        print("\n".join(condensed(plan)))
        print("```\n")


if __name__ == "__main__":
    main()
