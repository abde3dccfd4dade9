"""Side-by-side check of a Spark binding against its DuckDB oracle SQL.

Used by the test-suite and runnable as a script:
    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os
import sys
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) or isinstance(v, np.floating):
        if math.isnan(v):
            return None
        return round(float(v), 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().isoformat()
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    return v


def rows(pdf: pd.DataFrame) -> Counter:
    cols = sorted(pdf.columns)
    out = Counter()
    for rec in pdf[cols].itertuples(index=False, name=None):
        out[tuple(_norm(x) for x in rec)] += 1
    return out


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    sys.path.insert(0, ROOT)
    import __spark_entry__ as E
    q = E.queries()[name]
    sql = E.oracle_sql().get(name)
    sdf = q(spark, sf_dir)
    spdf = sdf.toPandas()
    res = {"name": name, "spark_rows": len(spdf), "spark_cols": sorted(spdf.columns)}
    if sql is None:
        res["ok"] = None
        return res
    con = con or duck(sf_dir)
    dpdf = con.execute(sql).df()
    res["duck_rows"] = len(dpdf)
    res["duck_cols"] = sorted(dpdf.columns)
    if res["spark_cols"] != res["duck_cols"]:
        res["ok"] = False
        res["why"] = "columns"
        return res
    sdt = {c: str(spdf[c].dtype) for c in spdf.columns}
    ddt = {c: str(dpdf[c].dtype) for c in dpdf.columns}
    res["dtype_diff"] = {c: (sdt[c], ddt[c]) for c in sdt if sdt[c] != ddt[c]}
    a, b = rows(spdf), rows(dpdf)
    res["ok"] = a == b
    if not res["ok"]:
        res["why"] = "values"
        res["only_spark"] = list((a - b).items())[:3]
        res["only_duck"] = list((b - a).items())[:3]
    return res


if __name__ == "__main__":
    from tessera.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    if os.environ.get("ORACLE_PLAIN"):
        # a session with none of the engine's settings (as an outside driver may use)
        from pyspark.sql import SparkSession
        b = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        if os.environ.get("ORACLE_TZ"):
            b = b.config("spark.sql.session.timeZone", os.environ["ORACLE_TZ"])
        spark = b.getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = get_session("local[8]")
    import __spark_entry__ as E
    con = duck(sf)
    allq = E.queries()
    names = names or list(allq)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf, con)
        except Exception as e:  # report and continue
            r = {"name": n, "ok": False, "why": f"error {type(e).__name__}: {str(e)[:400]}"}
        if r.get("ok") is False:
            bad += 1
        flag = {True: "OK ", False: "BAD", None: "n/a"}[r.get("ok")]
        extra = "" if r.get("ok") else {k: v for k, v in r.items() if k not in ("name", "ok")}
        dd = r.get("dtype_diff")
        print(f"{flag} {n} rows={r.get('spark_rows')}/{r.get('duck_rows')} "
              f"{('dtypes=' + str(dd)) if dd else ''} {extra if extra else ''}", flush=True)
    print(f"{bad} bad of {len(names)}")
