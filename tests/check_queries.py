"""Ad-hoc runner: python tests/check_queries.py [sf] [name ...]."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import compare, oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from modelwatch.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                   "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                n = compare(spark, con, fn, sql[name], sf_dir)
            else:
                n = f"{fn(spark, sf_dir).count()} (rows only)"
            print(f"ok   {name:28s} rows={n} {time.time() - start:.2f}s", flush=True)
        except Exception as e:
            failed.append(name)
            text = str(e) if isinstance(e, AssertionError) else "".join(traceback.format_exception_only(e))
            print(f"FAIL {name:28s} {text[:1500]}", flush=True)
    print("failed:", failed)
