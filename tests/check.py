"""Run registered queries against their statements: python tests/check.py SF_DIR [name or prefix ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from rideops.session import build_session  # noqa: E402
from tests.compare import connect, differences  # noqa: E402

if __name__ == "__main__":
    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
                                                "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(sf), entry.oracle_sql(), 0
    queries = entry.queries()
    for name, query in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = query(spark, sf)
            if name in oracle:
                problems = differences(df, con, oracle[name])
            else:
                problems, rows = [], len(df.collect())
                print(f"rows {rows}", end=" ")
        except Exception as e:  # report and go on
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - start:.1f}s", flush=True)
        for p in problems:
            print("   ", p[:2500])
    print("bad:", bad, "keys:", len(queries), "with oracle:", len(oracle))
