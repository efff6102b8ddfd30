"""Compare every registered query against its oracle SQL on DuckDB, as the driver does.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Set ORACLE_REPORT=path.json to also write the per-query report as JSON.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from ladder.sources.tables import TABLES, table_path  # noqa: E402


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None)]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def compare(spark, sf_dir: str, names=None) -> dict:
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    report = {}
    for name in names or list(qs):
        t = time.time()
        sdf = qs[name](spark, sf_dir)
        s = sdf.toPandas()
        secs = time.time() - t
        if name not in sqls:
            report[name] = {"status": "rows-only", "rows": len(s)}
            continue
        rel = con.execute(sqls[name])
        duck_types = {col[0]: str(col[1]) for col in rel.description}
        d = rel.fetchdf()
        entry = {"rows": (len(s), len(d)), "sec": round(secs, 2)}
        if sorted(s.columns) != sorted(d.columns):
            entry["status"] = f"COLUMNS {sorted(s.columns)} vs {sorted(d.columns)}"
        elif rows_of(s) != rows_of(d):
            a, b = rows_of(s), rows_of(d)
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            entry["status"] = f"VALUES differ: {diff}"
        else:
            entry["status"] = "ok"
        entry["spark_types"] = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
        entry["duck_types"] = duck_types
        report[name] = entry
    return report


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    import os

    builder = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC"))
    # Extra session settings to check robustness, e.g. LADDER_CONF="spark.sql.adaptive.enabled=false"
    for kv in filter(None, os.environ.get("LADDER_CONF", "").split(",")):
        k, v = kv.split("=", 1)
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    rep = compare(spark, sf_dir, names)
    bad = 0
    for k, v in rep.items():
        print(f"{k:32s} {v.get('status')[:300]} rows={v.get('rows')} sec={v.get('sec')}")
        if v.get("status") == "ok":
            st, dt = v["spark_types"], v["duck_types"]
            print("     types:", {c: (st[c], dt.get(c)) for c in st})
        else:
            bad += 1
    print("mismatches:", bad)
    if os.environ.get("ORACLE_REPORT"):
        import json

        with open(os.environ["ORACLE_REPORT"], "w") as fh:
            json.dump({"sf_dir": sf_dir, "mismatches": bad, "queries": rep}, fh, indent=1, default=str,
                      ensure_ascii=False)
