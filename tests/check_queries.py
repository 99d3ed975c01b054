"""Run queries against their SQL: ``python tests/check_queries.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

import __spark_entry__ as entry  # noqa: E402
from oracle import connect, difference  # noqa: E402
from tidecase.session import build_session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    path = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            df = run(spark, path)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                note = ""
            else:
                problem, note = None, f"rows only: {df.count()}"
        except Exception as error:  # report every query, not only the first failure
            problem, note = f"{type(error).__name__}: {str(error)[:700]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {note} {problem or ''}", flush=True)
    print("failed", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
