"""Compare registered queries with their SQL: python tests/check.py [sf folder] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bazaarlens.plans.fixtures import TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)

    def cell(value):
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
            return "<null>"
        return repr(value.item() if hasattr(value, "item") else value)

    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False))


def compare(spark, name: str, folder: str, con) -> tuple[bool, str]:
    from bazaarlens.plans import ORACLES, QUERIES

    start = time.time()
    ours = QUERIES[name](spark, folder)
    kinds = dict(ours.dtypes)
    got = ours.toPandas()
    took = time.time() - start
    if name not in ORACLES:
        return len(got) > 0, f"{len(got)} rows, no oracle, {took:.1f}s"
    want = con.execute(ORACLES[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    left, right = canonical(got), canonical(want)
    if left == right:
        odd = [c for c, t in kinds.items() if t.startswith(("array", "struct", "map", "decimal"))]
        return True, f"{len(got)} rows, {took:.1f}s" + (f", nested {odd}" if odd else "")
    ours_set, want_set = set(left), set(right)
    a = [r for r in left if r not in want_set][:4]
    b = [r for r in right if r not in ours_set][:4]
    return False, f"{len(left)} vs {len(right)} rows\n  cols {sorted(got.columns)}\n  ours {a}\n  want {b}"


if __name__ == "__main__":
    from bazaarlens.plans import QUERIES
    from bazaarlens.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.001"
    spark = local_session()
    con = connect(folder)
    bad = 0
    for name in args or list(QUERIES):
        try:
            ok, note = compare(spark, name, folder, con)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failures:", bad)
