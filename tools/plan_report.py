"""Physical-plan summary of every registered query (writes PLANS.md).

usage: python tools/plan_report.py [sf_dir] > PLANS.md
Counts shuffles, join strategies, windows and Python nodes in each
query's final plan and lists what the parquet scans read and push down.
Streaming queries are summarised by their batch read-back plan.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = [("Exchange hashpartitioning", "hash shuffle"), ("Exchange rangepartitioning", "range shuffle"),
         ("Exchange SinglePartition", "single-partition"), ("BroadcastExchange", "broadcast"),
         ("SortMergeJoin", "SMJ"), ("BroadcastHashJoin", "BHJ"), ("ShuffledHashJoin", "SHJ"),
         ("BroadcastNestedLoopJoin", "BNLJ"), ("CartesianProduct", "cartesian"),
         ("Window ", "window"), ("ArrowEvalPython", "arrow-udf"), ("BatchEvalPython", "row-udf"),
         ("FlatMapGroupsInPandas", "pandas-group"), ("MapInPandas", "map-in-pandas"),
         ("FlatMapGroupsInPandasWithState", "pandas-state")]


def summarise(plan: str) -> tuple[Counter, list[str]]:
    c = Counter()
    for line in plan.splitlines():
        for pat, name in KINDS:
            if pat in line:
                c[name] += 1
    scans = []
    for m in re.finditer(r"FileScan parquet [^\n]*", plan):
        s = m.group(0)
        loc = re.search(r"Location: \w+\(\d+ paths\)\[([^\]]+)\]", s)
        schema = re.search(r"ReadSchema: (struct<[^\n]*>)", s)
        pushed = re.search(r"PushedFilters: \[([^\]]*)\]", s)
        name = os.path.basename(loc.group(1)) if loc else "?"
        scans.append(f"{name} {schema.group(1) if schema else ''}"
                     + (f" pushed[{pushed.group(1)}]" if pushed and pushed.group(1) else ""))
    return c, scans


def main() -> None:
    from qoeflow.plans.catalog import REGISTRY
    from qoeflow.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]")
    print("# PLANS — physical plan summary per registered query\n")
    print(f"Generated by `tools/plan_report.py` at `{sf}` on local[8] with AQE on (initial plan, "
          "before runtime re-planning).  Counts include scalar subqueries.\n")
    print("| query | shuffles (hash/range/single) | joins | windows | python | scans |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name, f in REGISTRY.items():
        df = f(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        c, scans = summarise(plan)
        sh = f"{c['hash shuffle']}/{c['range shuffle']}/{c['single-partition']}"
        joins = ", ".join(f"{c[k]} {k}" for k in ("BHJ", "SMJ", "SHJ", "BNLJ", "cartesian") if c[k]) or "-"
        py = ", ".join(f"{c[k]} {k}" for k in ("arrow-udf", "row-udf", "pandas-group", "map-in-pandas",
                                                  "pandas-state") if c[k]) or "-"
        uniq = sorted(set(scans))
        print(f"| `{name}` | {sh} | {joins} | {c['window'] or '-'} | {py} | "
              + "<br>".join(s.replace("|", "/") for s in uniq) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
