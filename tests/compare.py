"""Runs registered queries against their SQL in DuckDB: python -m tests.compare [sf] [name...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    if hasattr(value, "as_tuple"):
        return repr(float(value))
    return repr(value)


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    rows = [tuple(r) for r in df.collect()]
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    expected = found.fetchall()
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
        return problems
    if len(rows) != len(expected):
        problems.append(f"{len(rows)} rows != {len(expected)}")
    a, b = canonical(df.columns, rows), canonical(names, expected)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:4]
        problems.append(f"{sum(x != y for x, y in zip(a, b))} rows differ on {sorted(names)}, first: {bad}")
    if not rows:
        problems.append("no rows")
    return problems


def main() -> int:
    from cohortia.session import build_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", 8, {"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = []
    for name, run in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in sql:
                problems = differences(df, con, sql[name])
            else:
                problems = [] if df.count() >= 1 else ["no rows"]
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        mark = "ok  " if not problems else "FAIL"
        print(f"{mark} {name} {time.time() - start:.2f}s {'' if name in sql else '(rows only)'}", flush=True)
        for problem in problems:
            print("     ", problem, flush=True)
        if problems:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
