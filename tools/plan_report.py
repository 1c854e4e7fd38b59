"""Summarise the physical plans of the headline queries (after execution,
so AQE's final choices show): shuffles, broadcasts, join kinds, top-k
limits, and the filters pushed into the log scans. Writes markdown."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from habitlake.plans.registry import REGISTRY, builders  # noqa: E402
from habitlake.session import get_session  # noqa: E402
from habitlake.sources.fixtures import Fixtures  # noqa: E402


def summary(plan: str) -> dict:
    joins = re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)"
                       r"[^\n]*?(Inner|LeftOuter|LeftAnti|LeftSemi|FullOuter|RightOuter|ExistenceJoin)", plan)
    pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]*(?:logged_at|created_at|ts)[^\]]*)\]", plan)))
    return {"shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin",
                                       plan)),
            "broadcasts": plan.count("BroadcastExchange"),
            "joins": ", ".join(sorted({f"{a} {b}" for a, b in joins})) or "-",
            "top_k": "WindowGroupLimit" in plan, "pushed_time_filters": "; ".join(pushed)[:160] or "-"}


def main():
    app_dir = sys.argv[1]
    names = sys.argv[2:]
    spark = get_session()
    builders()
    fx = Fixtures(spark, "/root/testdata/sf0.1", app_dir)
    rows = ["| query | shuffles | broadcasts | joins (final plan) | top-k limit | time filters pushed to scan |",
            "|---|---|---|---|---|---|"]
    for n in names:
        df = REGISTRY[n].build(fx)
        df.write.format("noop").mode("overwrite").save()
        s = summary(df._jdf.queryExecution().executedPlan().toString())
        rows.append(f"| {n} | {s['shuffles']} | {s['broadcasts']} | {s['joins']} | {'yes' if s['top_k'] else '-'} "
                    f"| {s['pushed_time_filters']} |")
    print("\n".join(rows))


if __name__ == "__main__":
    main()
