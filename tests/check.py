"""Run registered queries on Spark and their SQL twins on DuckDB, compare row multisets.

    python -m tests.check [sf] [name ...]
"""

from __future__ import annotations

import collections
import math
import sys
import time

import duckdb

from postmill.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


SAME = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE",
}


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return round(float(v), 9)
    return v


def oracle_rows(con, sql):
    r = con.execute(sql)
    cols = [d[0] for d in r.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], [str(r.description[i][1]) for i in order], [
        tuple(norm(row[i]) for i in order) for row in r.fetchall()
    ]


def spark_rows(df):
    cols = df.columns
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    types = [df.dtypes[i][1] for i in order]
    return [cols[i] for i in order], types, [
        tuple(norm(row[i]) for i in order) for row in df.collect()
    ]


def compare(spark, con, fn, sql, sf):
    t0 = time.time()
    cols, types, rows = spark_rows(fn(spark, sf))
    t1 = time.time()
    if sql is None:
        return True, f"rows-only {len(rows)} ({t1 - t0:.1f}s)"
    ocols, otypes, orows = oracle_rows(con, sql)
    if cols != ocols:
        return False, f"columns {cols} != {ocols}"
    a, b = collections.Counter(rows), collections.Counter(orows)
    if a != b:
        only_s, only_o = list((a - b).items())[:3], list((b - a).items())[:3]
        return False, (
            f"rows {len(rows)} vs {len(orows)}, differ {sum((a - b).values())}\n   {cols}\n"
            f"   spark  {only_s}\n   oracle {only_o}"
        )
    odd = [(c, t, o) for c, t, o in zip(cols, types, otypes) if SAME.get(t) != o]
    return not odd, f"rows {len(rows)} ({t1 - t0:.1f}s)" + (f" TYPES {odd}" if odd else "")


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def main(argv):
    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.01"
    base = f"/root/testdata/sf{sf}"
    qs, osql = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not argv[1:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv[1:])]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(base)
    bad = []
    for n in names:
        try:
            ok, msg = compare(spark, con, qs[n], osql.get(n), base)
        except Exception as e:  # report and go on with the next query
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        if not ok:
            bad.append(n)
        print(("ok   " if ok else "FAIL ") + n, msg, flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} ok; failed: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
