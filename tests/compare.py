"""Run registered queries on Spark and their statements on DuckDB and compare whole results."""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.12g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return plain(list(v))
    return repr(v)


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in at) for r in rows), [columns[i] for i in at]


def compare(spark, con, name, fn, sql, sf):
    started = time.time()
    df = fn(spark, sf)
    got = df.collect()
    took = time.time() - started
    if sql is None:
        return True, took, f"rows={len(got)} (no statement)"
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    a, ac = rows_of(df.columns, got)
    b, bc = rows_of(want_cols, want)
    if ac != bc:
        return False, took, f"columns {ac} != {bc}"
    kinds = {n: t for n, t in df.dtypes}
    theirs = {d[0]: str(d[1]) for d in cur.description}
    if a == b:
        soft = [f"{n}:{kinds[n]}/{theirs[n]}" for n in kinds if loose(kinds[n]) != loose(theirs[n])]
        return not soft, took, f"rows={len(a)} {soft or ''}"
    in_a, in_b = set(a), set(b)
    only_a = [r for r in a if r not in in_b][:2]
    only_b = [r for r in b if r not in in_a][:2]
    return False, took, f"rows {len(a)} vs {len(b)}; spark {only_a}; sql {only_b}"


def loose(kind: str) -> str:
    k = kind.lower()
    if k in ("bigint", "long"):
        return "bigint"
    if k in ("int", "integer"):
        return "int"
    if k in ("string", "varchar"):
        return "string"
    return k if not k.startswith("timestamp") else "timestamp"


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from marktrace.session import build_session

    sf = os.environ.get("COMPARE_SF", "/root/testdata/sf0.01")
    spark = build_session()
    if os.environ.get("SLICE_ROWS"):
        spark.conf.set("marktrace.sliceRows", os.environ["SLICE_ROWS"])
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    bad = []
    for n in names:
        try:
            ok, took, note = compare(spark, con, n, queries[n], sql.get(n), sf)
        except Exception as err:  # noqa: BLE001
            ok, took, note = False, 0.0, f"{type(err).__name__}: {str(err)[:700]}"
        print(("ok  " if ok else "BAD ") + f"{n} {took:.2f}s {note}"[:1200], flush=True)
        if not ok:
            bad.append(n)
    print(f"{len(names) - len(bad)}/{len(names)} ok; bad: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
