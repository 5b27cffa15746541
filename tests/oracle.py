"""Run registered queries next to their SQL in DuckDB and compare the results.

``python tests/oracle.py [sf_dir] [name-prefix ...]``
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return v


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda t: tuple((x is None, str(type(x).__name__ if isinstance(x, bool) else ""), str(x)) for x in t))


def compare(spark_df, sql, con):
    rows = [tuple(r) for r in spark_df.collect()]
    names, got = canonical(spark_df.columns, rows)
    cur = con.execute(sql)
    d_names = [d[0] for d in cur.description]
    o_names, want = canonical(d_names, cur.fetchall())
    if names != o_names:
        return f"columns differ: {names} vs {o_names}", len(got)
    if len(got) != len(want):
        return f"row counts differ: {len(got)} vs {len(want)}\n  {got[:3]}\n  {want[:3]}", len(got)
    for a, b in zip(got, want):
        for n, x, y in zip(names, a, b):
            if x != y or type(x).__name__ != type(y).__name__:
                return f"{n}: {x!r} vs {y!r}\n  {a}\n  {b}", len(got)
    return None, len(got)


def main(argv):
    from tabloom.session import get_spark
    from queries import load_all

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = tuple(argv[1:])
    spark = get_spark("oracle", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                      spark__driver__memory="16g", spark__log__level="ERROR")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = load_all()
    bad, slow = [], []
    for name, fn in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                t1 = time.time()
                problem, n = compare(df, sql[name], con)
            else:
                problem, n = None, len(df.collect())
            took = time.time() - t0
            if problem:
                bad.append(name)
                print(f"BAD  {name} {took:.1f}s: {problem}", flush=True)
            else:
                print(f"ok   {name} rows={n} {took:.1f}s{'' if name in sql else ' (rows only)'}", flush=True)
            if took > 8:
                slow.append((name, round(took, 1)))
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            text = str(e).split("JVM stacktrace")[0][:900]
            print(f"FAIL {name}: {type(e).__name__} {text}", flush=True)
            if len(prefixes) == 1:
                traceback.print_exc(limit=-4)
    print("bad:", bad, "slow:", slow)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
