"""Compare a registered query with its SQL statement on DuckDB, as sorted, typed rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

TESTDATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if v else "0.0"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return f"dec{v}"
    return f"{type(v).__name__}:{v!r}"


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> str:
    """Empty when equal, else what differs."""
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = norm(got, df.columns), norm(want, names)
    if a == b:
        return "" if a else "both empty"
    only_a = sorted(set(a) - set(b))[:2]
    only_b = sorted(set(b) - set(a))[:2]
    return f"rows {len(a)} vs {len(b)}; columns {sorted(names)}\n   spark  {only_a}\n   duckdb {only_b}"


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pagelayout.session import local_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    con = connect(f"{TESTDATA}/{sf}")
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, f"{TESTDATA}/{sf}")
            if name in sqls:
                msg = compare(df, con, sqls[name])
            else:
                msg = f"" if (n := len(df.collect())) else "no rows"
                print(f"     rows only: {n}")
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            msg = f"{type(e).__name__}: {str(e)[:400]}"
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name} {time.time() - t0:.1f}s {msg}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
