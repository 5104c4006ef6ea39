"""Side-by-side check of a Spark query against its DuckDB SQL twin (as the driver does it):
row count, column names and an order-insensitive hash of the values."""

from __future__ import annotations

import hashlib
import math
import os
import sys

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def rows_digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest(), keyed


def compare(spark, con, name, query_fn, sql, sf_dir, show=3):
    df = query_fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    res = con.sql(sql)
    d_cols = res.columns
    d_rows = res.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    sh, sk = rows_digest(s_cols, s_rows)
    dh, dk = rows_digest(d_cols, d_rows)
    ok = ok_cols and len(s_rows) == len(d_rows) and sh == dh
    print(f"{name}: {'OK' if ok else 'MISMATCH'} rows spark={len(s_rows)} duck={len(d_rows)}"
          f" cols_ok={ok_cols}", flush=True)
    if not ok:
        if not ok_cols:
            print("  spark cols", sorted(s_cols), "\n  duck cols ", sorted(d_cols))
        sset, dset = set(sk), set(dk)
        for r in sorted(sset - dset)[:show]:
            print("  spark only:", r[:600])
        for r in sorted(dset - sset)[:show]:
            print("  duck only: ", r[:600])
    return ok


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from pagecorpus.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_spark(os.environ.get("COMPARE_MASTER", "local[8]"), 8)
    con = duck_connect(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = []
    for n in (names or list(qs)):
        if n not in sqls:
            df = qs[n](spark, sf)
            print(f"{n}: rows-only {df.count()}")
            continue
        try:
            if not compare(spark, con, n, qs[n], sqls[n], sf):
                bad.append(n)
        except Exception as exc:  # report and continue
            print(f"{n}: ERROR {type(exc).__name__}: {str(exc)[:800]}")
            bad.append(n)
    print("BAD:", bad)
