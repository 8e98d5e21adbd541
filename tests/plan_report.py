"""Print, per query, what its physical plan contains: python tests/plan_report.py [sf] [name ...]."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from modelwatch.session import build_session  # noqa: E402

MARKS = ["BroadcastNestedLoopJoin", "CartesianProduct", "SortAggregate", "ObjectHashAggregate", "ArrowEvalPython",
         "FlatMapGroupsInPandas", "Window", "WindowGroupLimit", "ReusedExchange", "Generate", "SortMergeJoin",
         "BroadcastHashJoin", "ShuffledHashJoin"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def report(text):
    counts = {m: len(re.findall(rf"\b{m}\b(?!Limit)", text)) for m in MARKS}
    counts["Exchange"] = len(re.findall(r"(?<!Reused)(?<!Broadcast)\bExchange\b", text))
    counts["single"] = len(re.findall(r"Exchange SinglePartition", text))
    counts["scan"] = len(re.findall(r"FileScan", text))
    return {k: n for k, n in counts.items() if n}


if __name__ == "__main__":
    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark = build_session("plans", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                   "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        if name.startswith("stream") or name in ("rf_replay", "feature_importance"):
            continue
        df = fn(spark, sf_dir)
        text = plan_of(df)
        print(f"{name:28s} {report(text)}", flush=True)
        if len(sys.argv) > 2:
            df.explain("formatted")
