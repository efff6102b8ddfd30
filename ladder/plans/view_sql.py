"""The derived test views as SQL common table expressions (DuckDB and Spark SQL), for the oracle.

The oracle runs on base tables only, so every query inlines the views it reads as CTEs.
"""

from __future__ import annotations

from ladder.sources.views import SEGMENT_TO_EDUCATION  # noqa: E402  (the fixture rule, one source)

_SEGMENT_CASES = "\n             ".join(
    f"WHEN c.c_mktsegment = '{segment}' THEN '{group}'" for segment, group in SEGMENT_TO_EDUCATION)

_PANEL = [
    ("_spend", """
    SELECT o_custkey AS hid,
           CAST(year(o_orderdate) AS INTEGER) AS year,
           SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS inc,
           SUM(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS debt
    FROM orders
    GROUP BY o_custkey, CAST(year(o_orderdate) AS INTEGER)"""),
    ("_ranked", """
    SELECT hid, year, inc, debt,
           SUM(inc) OVER (PARTITION BY hid ORDER BY year
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ast,
           NTILE(10) OVER (PARTITION BY year ORDER BY inc, hid) AS dec
    FROM _spend"""),
    ("_history", """
    SELECT hid, year, inc, debt, ast, dec,
           LAG(dec) OVER (PARTITION BY hid ORDER BY year) AS prv,
           year - LAG(year) OVER (PARTITION BY hid ORDER BY year) AS gap
    FROM _ranked"""),
    ("panel", f"""
    SELECT
        CASE WHEN s.hid % 41 = 0 THEN NULL ELSE s.hid END AS household_id,
        p.person_no,
        s.year,
        CAST(s.inc AS DOUBLE) AS h_total_income,
        CAST(s.ast AS DOUBLE) AS h_total_asset,
        CAST(s.debt AS DOUBLE) AS h_total_debt,
        c.c_acctbal AS h_net_asset,
        CAST(s.dec AS DOUBLE) AS h_incomeq,
        CAST(s.prv AS DOUBLE) AS prev_income_decile,
        CAST(s.gap AS INTEGER) AS year_gap,
        CASE WHEN s.prv IS NULL THEN NULL
             WHEN s.dec > s.prv THEN 'upward'
             WHEN s.dec < s.prv THEN 'downward'
             ELSE 'stable' END AS income_mobility_type,
        CASE WHEN s.hid % 29 = 0 THEN NULL
             {_SEGMENT_CASES} END AS education_group,
        CAST(CASE WHEN s.hid % 31 = 0 THEN 9 ELSE (s.hid + p.person_no) % 3 + 1 END AS DOUBLE) AS p_employment_type,
        CAST(c.c_nationkey % 6 + 1 AS DOUBLE) AS p_firm_size,
        CAST((s.hid + p.person_no) % 5 + 1 AS DOUBLE) AS p_job_status,
        CASE WHEN s.hid % 37 = 0 THEN 'other'
             WHEN c.c_acctbal < 0 THEN 'young'
             WHEN c.c_acctbal < 5000 THEN 'middle'
             ELSE 'senior' END AS generation,
        CASE WHEN p.person_no = 3 THEN NULL
             WHEN s.hid % 7 = 0 THEN CAST(0.0 AS DOUBLE)
             ELSE CAST(s.inc AS DOUBLE) / 12 / p.person_no END AS p_monthly_wage
    FROM _history s
    JOIN customer c ON c.c_custkey = s.hid
    JOIN (VALUES (1), (2), (3)) AS p(person_no) ON p.person_no <= s.hid % 3 + 1"""),
]

_PARENT_CHILD = [
    ("parent_child", """
    SELECT
        CAST((c_custkey % 3 + 1) * 1000000 + c_custkey AS BIGINT) AS student_id,
        CAST(NTILE(5) OVER (ORDER BY c_acctbal, c_custkey) AS DOUBLE) AS parent_quintile,
        CAST(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey % 6 + 1 END AS INTEGER) AS child_edu,
        CAST(CASE WHEN c_custkey % 13 = 0 THEN NULL
                  WHEN c_nationkey % 6 + 1 >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_grad
    FROM customer"""),
]

_EDU_SPEND = [
    ("edu_spend", """
    SELECT l.l_linenumber AS income_band,
           l.l_extendedprice AS total_cost,
           l.l_quantity AS weight,
           n.n_regionkey AS city
    FROM lineitem l
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
    JOIN nation n ON s.s_nationkey = n.n_nationkey"""),
]

_INSTITUTION = [
    ("institution", """
    SELECT c.c_name AS name,
           n.n_regionkey AS city,
           CASE WHEN c.c_custkey % 19 = 0 THEN NULL
                WHEN c.c_custkey % 17 = 0 THEN ''
                WHEN c.c_custkey % 23 = 0 THEN '-'
                ELSE CAST(ROUND(c.c_acctbal / 100, 1) AS VARCHAR) END AS rate_text
    FROM customer c
    JOIN nation n ON c.c_nationkey = n.n_nationkey"""),
]

VIEW_CTES = {
    "panel": _PANEL,
    "parent_child": _PARENT_CHILD,
    "edu_spend": _EDU_SPEND,
    "institution": _INSTITUTION,
}


def with_views(views: list[str], body: str, keep: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs of ``views``, of which only the rows that ``keep`` names are used; a body that starts
    with WITH is merged flat."""
    ctes = []
    for v in views:
        for name, sql in VIEW_CTES[v]:
            if name == v and v in (keep or {}):
                sql = f"SELECT * FROM ({sql}\n) WHERE {keep[v]}"
            ctes.append(f"{name} AS ({sql}\n)")
    body = body.strip().rstrip(";")
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body
