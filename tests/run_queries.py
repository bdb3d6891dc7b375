"""Run registered queries against DuckDB: python tests/run_queries.py [scale] [name part ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from cellweave.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    parts = sys.argv[2:]
    spark = build_session("queries", cpus=8, partitions=8)
    con = connect(sf)
    sql = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sql:
                n, problems = compare(df, con, sql[name])
            else:
                rows = df.collect()
                n, problems = len(rows), [] if rows else ["no rows"]
            state = "ok " if not problems else "BAD"
        except Exception as e:  # noqa: BLE001
            n, problems, state = 0, [str(e)[:1500]], "ERR"
        print(f"{state} {name:32s} {n:8d} rows {time.time() - t:6.2f}s {'' if name in sql else '(rows only)'} {' | '.join(problems)}", flush=True)
        if problems:
            failed.append(name)
    print("failed:", failed)
