"""Compare registered queries with their SQL on one data directory.

usage: python tests/check.py [sf] [key-prefix ...]
"""
import os, sys, time
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb
import pandas as pd
from atlas_spark.fixtures import BASE
from atlas_spark.session import build_session


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    def norm(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return repr(float(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and getattr(v, "ndim", 1) == 0:
            f = float(v)
            return repr(f + 0.0)
        return str(v)
    return list(pdf.columns), sorted(tuple(norm(v) for v in r) for r in pdf.itertuples(index=False))


def connect(sf_dir):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    got = fn(spark, sf_dir)
    types = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    gc, g = rows(got.toPandas())
    if sql is None:
        return f"rows-only {len(g)}", True
    rel = con.sql(sql)
    dt = dict(zip(rel.columns, map(str, rel.types)))
    wc, w = rows(rel.df())
    if gc != wc:
        return f"columns {gc} != {wc}", False
    odd = {n: (types[n], dt[n]) for n in types
           if (types[n], dt[n]) not in {("string", "VARCHAR"), ("bigint", "BIGINT"), ("int", "INTEGER"),
                                        ("double", "DOUBLE"), ("boolean", "BOOLEAN"), ("float", "FLOAT"), ("date", "DATE")}}
    if g != w:
        bad = [(a, b) for a, b in zip(g, w) if a != b][:3]
        return f"values differ rows {len(g)} vs {len(w)} {gc} {str(bad)[:600]}", False
    return f"{len(g)} rows" + (f" TYPES {odd}" if odd else "") + (" EMPTY" if not g else ""), True


if __name__ == "__main__":
    import __spark_entry__ as e
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = build_session("local[8]", 8), connect(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    keys = [k for k in qs if len(sys.argv) < 3 or any(k.startswith(p) for p in sys.argv[2:])]
    bad = 0
    for k in keys:
        t = time.time()
        try:
            msg, ok = compare(spark, con, sf_dir, qs[k], sqls.get(k))
        except Exception as x:
            msg, ok = f"{type(x).__name__}: {str(x)[:700]}", False
        bad += not ok
        flag = "ok  " if ok else "FAIL"
        if not ok or "-q" not in os.environ.get("CHECK", "") or "TYPES" in msg or "EMPTY" in msg:
            print(f"{flag} {k:28s} {time.time()-t:5.1f}s {msg}", flush=True)
    print(f"{len(keys)} checked, {bad} failed")
