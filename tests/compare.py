"""Run registered queries and their check SQL side by side: python tests/compare.py [sf] [name...]"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, bool):
        return str(v)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark_rows, sql_rows) -> str:
    (c1, r1), (c2, r2) = spark_rows, sql_rows
    if c1 != c2:
        return f"columns {c1} vs {c2}"
    if len(r1) != len(r2):
        a, b = set(r1), set(r2)
        return f"rows {len(r1)} vs {len(r2)}; only spark {list(a - b)[:2]}; only sql {list(b - a)[:2]}"
    bad = [(x, y) for x, y in zip(r1, r2) if x != y]
    if bad:
        a, b = set(r1), set(r2)
        return f"{len(bad)} rows differ; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    return ""


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry
    from loglattice.session import build_session

    spark = build_session(
        master="local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g", spark__sql__shuffle__partitions="8",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:]
    names = [q for q in queries if not wanted or any(q.startswith(w) for w in wanted)]
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if name not in sql:
                print(f"rows {name}: {len(got[1])} rows {took:.1f}s")
                continue
            start = time.time()
            cur = con.execute(sql[name])
            ref = rows_of([d[0] for d in cur.description], cur.fetchall())
            problem = compare(got, ref)
            if not got[1]:
                problem = problem or "EMPTY"
            print(f"{'FAIL' if problem else 'ok  '} {name}: {len(got[1])} rows {took:.1f}s sql {time.time() - start:.1f}s {problem[:1500]}")
            failed += bool(problem)
        except Exception as error:  # report and go on with the next query
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:1200]}")
            failed += 1
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
