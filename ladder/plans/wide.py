"""Matrices with more observed rows than a code domain has (R2, R3), as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ladder.operators.reshape import dense_rows
from ladder.sources.tables import read_table

STATUSES = {"F": "fulfilled", "O": "open", "P": "partly"}


def customer_status_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's largest order per order status, missing cells 0."""
    orders = read_table(spark, sf_dir, "orders")
    return dense_rows(orders, "o_custkey", "o_orderstatus", "o_totalprice", list(STATUSES), agg="max", col_labels=STATUSES)


QUERIES = {"customer_status_dense": customer_status_dense}

_LISTED = ", ".join(f"({i}, '{code}', '{label}')" for i, (code, label) in enumerate(STATUSES.items(), 1))

ORACLE_SQL = {"customer_status_dense": f"""
WITH k AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS row_pos
           FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL)),
c AS (SELECT * FROM (VALUES {_LISTED}) AS s(col_pos, code, col_label)),
v AS (SELECT o_custkey, o_orderstatus, MAX(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT row_pos, CAST(k.o_custkey AS VARCHAR) AS row_label, CAST(col_pos AS INTEGER) AS col_pos, col_label,
       COALESCE(CAST(ROUND(CAST(CAST(v AS VARCHAR) AS DECIMAL(38, 12)), 1) AS DOUBLE), 0.0) AS value
FROM k CROSS JOIN c LEFT JOIN v ON v.o_custkey = k.o_custkey AND o_orderstatus = code"""}
