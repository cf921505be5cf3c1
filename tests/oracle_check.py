"""Compare registered Spark queries with their DuckDB oracle SQL.

Usage: ``python tests/oracle_check.py /root/testdata/sf0.01 [name ...]``.
The comparison mirrors the driver: row count, column names, and an
order-insensitive multiset of rows with columns sorted by name.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v, digits):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits) if digits is not None else v
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        # a DATE may arrive as a midnight datetime64 through pandas
        return dt.datetime(v.year, v.month, v.day).isoformat()
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    return v


def rows(pdf: pd.DataFrame, digits=None):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].astype(object).itertuples(index=False, name=None):
        out.append(tuple(_norm(v, digits) for v in rec))
    return cols, sorted(out, key=repr)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> dict:
    sc, sr = rows(spark_pdf)
    dc, dr = rows(duck_pdf)
    res = {"rows_spark": len(sr), "rows_oracle": len(dr),
           "columns_match": sc == dc, "exact": sc == dc and sr == dr}
    if not res["exact"] and sc == dc:
        _, sr9 = rows(spark_pdf, 9)
        _, dr9 = rows(duck_pdf, 9)
        res["approx"] = sr9 == dr9
    if sc != dc:
        res["spark_columns"], res["oracle_columns"] = sc, dc
    res["ok"] = res["exact"] or res.get("approx", False)
    if not res["ok"] and sc == dc:
        missing = [r for r in dr if r not in set(sr)][:3]
        extra = [r for r in sr if r not in set(dr)][:3]
        res["oracle_only"], res["spark_only"] = missing, extra
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from crashlens.session import build_session
    spark = build_session()
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            sp = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name}: SPARK ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in sql:
            print(f"{name}: rows={len(sp)} (no oracle) {t1 - t0:.2f}s")
            continue
        try:
            dk = con.execute(sql[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name}: DUCKDB ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        res = compare(sp, dk)
        flag = "OK " if res["ok"] else "BAD"
        bad += 0 if res["ok"] else 1
        print(f"{flag} {name}: spark {t1 - t0:.2f}s {res}")
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
