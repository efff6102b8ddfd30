"""Cross-checks of the statements on other execution paths, compared with the DataFrame results:

* ``sqlite``: the reference's engine — an in-memory SQLite (Python's sqlite3, in-process) with its own
  ROUND, AVG and window functions, over the materialised views. The spend/institution statement is
  skipped (SQLite lacks regular expressions).
* ``sparksql``: the same statements as Spark SQL text over temp views (``register_views``).

Usage: python tests/engine_crosscheck.py [sf_dir] [sqlite|sparksql]
"""

from __future__ import annotations

import math
import sqlite3
import sys

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from ladder.plans.dashboard import STATEMENTS  # noqa: E402
from ladder.plans.oracle import build_bodies  # noqa: E402
from ladder.plans.queries import QUERIES  # noqa: E402
from ladder.sources import register_views, views  # noqa: E402


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 9) if isinstance(v, float) else v


def _rows(records, cols):
    rows = [tuple(_norm(r[c]) for c in sorted(cols)) for r in records]
    return sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


def sparksql_crosscheck(spark, sf_dir: str) -> dict[str, int]:
    register_views(spark, sf_dir)
    bodies = build_bodies(dialect="spark")
    report = {}
    for name in STATEMENTS:
        sql_df = spark.sql(bodies[name][1])
        cols = sql_df.columns
        got = _rows([r.asDict() for r in sql_df.collect()], cols)
        spk = _rows([r.asDict() for r in QUERIES[name](spark, sf_dir).collect()], cols)
        report[name] = sum(a != b for a, b in zip(spk, got)) + abs(len(spk) - len(got))
    return report


def crosscheck(spark, sf_dir: str) -> dict[str, int]:
    con = sqlite3.connect(":memory:")
    views.panel(spark, sf_dir).toPandas().to_sql("panel", con, index=False)
    views.parent_child(spark, sf_dir).toPandas().to_sql("parent_child", con, index=False)
    bodies = build_bodies(dialect="sqlite")
    report = {}
    for name in STATEMENTS:
        used, sql = bodies[name]
        if not set(used) <= {"panel", "parent_child"}:
            continue
        cur = con.execute(sql)
        cols = [d[0] for d in cur.description]
        lite = _rows([dict(zip(cols, r)) for r in cur.fetchall()], cols)
        spk = _rows([r.asDict() for r in QUERIES[name](spark, sf_dir).collect()], cols)
        report[name] = sum(a != b for a, b in zip(spk, lite)) + abs(len(spk) - len(lite))
    return report


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    engine = sys.argv[2] if len(sys.argv) > 2 else "sqlite"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    rep = (sparksql_crosscheck if engine == "sparksql" else crosscheck)(spark, sf)
    for k, v in rep.items():
        print(f"{k:32s} differing rows: {v}")
    print("statements:", len(rep), "total differing rows:", sum(rep.values()))
