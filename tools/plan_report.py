"""Print the physical-plan shape of every registered report (markdown table).

Usage: python tools/plan_report.py [sf_dir]
Columns: tables scanned, hash / range / single-partition exchanges, broadcasts,
bucketed scan, top-k operator, scalar subqueries.  The plan is the adaptive
plan's initial physical plan (before run-time re-planning).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfwise.session import local_session  # noqa: E402


def shape(df) -> dict[str, object]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = set()
    for f in df.inputFiles():
        folder = f.rsplit("/", 2)
        scans.add(folder[2].replace(".parquet", "") if not folder[2].startswith("part-") else folder[1])
    if "ExistingRDD" in plan:
        scans.add("checkpoint of the ordered rows")
    return {
        "scans": ", ".join(sorted(scans)) or "-",
        "hash": plan.count("Exchange hashpartitioning"),
        "range": plan.count("Exchange rangepartitioning"),
        "single": plan.count("Exchange SinglePartition"),
        "broadcast": plan.count("BroadcastExchange"),
        "bucketed": "yes" if "Bucketed: true" in plan else "",
        "topk": "yes" if "TakeOrderedAndProject" in plan else "",
        "subq": plan.count("Subquery subquery"),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from shelfwise.plans import all_queries

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    print("| key | scans | hash exch. | range exch. | single-partition exch. | broadcast | bucketed scan | top-k | scalar subqueries |")
    print("|---|---|---|---|---|---|---|---|---|")
    for key, fn in all_queries().items():
        df = fn(spark, sf_dir)
        s = shape(df)
        print(
            f"| {key} | {s['scans']} | {s['hash']} | {s['range']} | {s['single']} | {s['broadcast']} "
            f"| {s['bucketed']} | {s['topk']} | {s['subq']} |"
        )


if __name__ == "__main__":
    main()
