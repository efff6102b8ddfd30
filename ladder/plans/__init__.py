"""Composed plans.

* ``queries``    the registered statements, matrices, documents and KPI rows (``QUERIES``)
* ``fused``      the latest-year statements from one pass (used by a refresh)
* ``dashboard``  one refresh: shared, persisted statement results and concurrent outputs
* ``oracle``     SQL for every query (DuckDB; SQLite and Spark SQL dialects for cross-checks)
* ``view_sql``   the derived test views as SQL CTEs, inlined by the oracle
"""
