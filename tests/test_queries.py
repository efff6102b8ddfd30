"""Registered queries: oracle parity (as the driver checks it), result order, plan shape, sinks."""

import json
import os
import shutil


from support import SF_SMALL
from oracle_compare import compare

import __spark_entry__ as entry_mod
from ladder.plans.queries import QUERIES

OWN = list(QUERIES)  # the library's own results; the optional text operators have tests of their own


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["prev_decile", "cur_decile", "n_households", "share"]
    assert df.count() > 0


def test_queries_and_oracles_cover_the_same_names():
    assert set(OWN) <= set(entry_mod.queries()) and set(OWN) <= set(entry_mod.oracle_sql())


def test_oracle_parity_small(spark):
    report = compare(spark, SF_SMALL, OWN)
    bad = {k: v["status"] for k, v in report.items() if v["status"] != "ok"}
    assert not bad, bad


def test_result_order_nulls_and_custom_rank(spark):
    q = QUERIES
    edu = [r.education_group for r in q["wage_by_education"](spark, SF_SMALL).collect()]
    order = ["elementary", "middle_school", "high_school", "college", "university", "graduate_school"]
    assert edu == [g for g in order if g in edu]
    mob = [r.mobility_type for r in q["mobility_share"](spark, SF_SMALL).collect()]
    assert mob == [m for m in ["upward", "stable", "downward"] if m in mob]
    dec = [r.decile for r in q["income_by_decile"](spark, SF_SMALL).collect()]
    assert dec == sorted(dec)


def test_properties_on_fixture(spark):
    q = QUERIES
    # shares within each group sum to 100 up to rounding (before densifying)
    for name, group in [("child_education_share", "quintile"), ("education_job_status_share", "education_group"),
                        ("employment_mobility_share", "employment_type"), ("income_transition_matrix", "prev_decile")]:
        sums = {}
        for r in q[name](spark, SF_SMALL).collect():
            sums[r[group]] = sums.get(r[group], 0.0) + r.share
        assert all(abs(v - 100.0) < 1.0 for v in sums.values()), (name, sums)
    # upward + stable + downward = 100
    assert abs(sum(r.share for r in q["mobility_share"](spark, SF_SMALL).collect()) - 100.0) < 0.3
    # the KPI equals the trend's latest point (both "upper retention")
    trend = q["escape_and_retention_trend"](spark, SF_SMALL).collect()
    kpi = q["upper_retention_kpi"](spark, SF_SMALL).first().upper_retention
    assert trend[-1].upper_retention_rate == kpi
    # dense matrix is exactly 10 x 10
    assert q["income_transition_dense"](spark, SF_SMALL).count() == 100


def test_plans_have_no_cartesian_product(spark):
    for name, fn in QUERIES.items():
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_latest_year_scan_prunes_partitions(spark):
    df = QUERIES["income_by_decile"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "= Subquery" in plan
    assert "ReadSchema: struct<h_total_income:double,h_incomeq:double>" in plan


def test_sinks(spark, tmp_out):
    from ladder.sources import to_records, write_all

    q = QUERIES
    rec = to_records(q["wage_by_education"](spark, SF_SMALL)).collect()
    first = json.loads(rec[0].record)
    assert set(first) == {"education_group", "n_samples", "avg_monthly_wage", "education_label"}
    assert any("초" in r.record or "졸" in r.record for r in rec)
    latest = q["latest_year"](spark, SF_SMALL)
    paths = write_all({"latest_year": latest}, tmp_out)
    assert spark.read.parquet(paths["latest_year"]).first().latest_year == latest.first().latest_year
    assert os.path.exists(os.path.join(paths["latest_year"], "_SUCCESS"))


def test_write_dashboard_writes_each_result(spark, tmp_out):
    from ladder.sources import write_dashboard

    q = QUERIES
    subset = {k: q[k] for k in ("latest_year", "mobility_share", "income_transition_dense")}
    paths = write_dashboard(spark, SF_SMALL, tmp_out, queries=subset, fmt="json")
    assert set(paths) == set(subset)
    back = spark.read.json(paths["income_transition_dense"])
    assert back.count() == 100
    labels = {r.mobility_label for r in spark.read.json(paths["mobility_share"]).collect()}
    assert labels <= {"상승", "유지", "하락"}


def test_dashboard_shares_statements_and_matches_independent_runs(spark):
    from ladder.plans.dashboard import dashboard, shared_statements

    names = ["child_education_matrix", "summary_kpis", "income_transition_chart", "wage_extremes"]
    q = QUERIES
    independent = {n: sorted(map(str, q[n](spark, SF_SMALL).collect())) for n in names}
    with shared_statements(spark, SF_SMALL) as run:
        res = dashboard(spark, run, names)
        plan = res["child_education_matrix"]._jdf.queryExecution().executedPlan().toString()
        shared = {n: sorted(map(str, df.collect())) for n, df in res.items()}
    assert shared == independent
    assert "InMemoryTableScan" in plan


def test_command_line_refresh_writes_every_result(spark, tmp_out):
    from ladder.__main__ import main

    paths = main([SF_SMALL, os.path.join(tmp_out, "dash"), "--format", "parquet", "--workers", "4"], spark=spark)
    assert set(paths) == set(OWN)
    assert spark.read.parquet(paths["income_transition_dense"]).count() == 100
    assert not spark.sparkContext._jsc.sc().isStopped()


def test_statements_equal_sqlite_engine(spark):
    """The reference's engine (SQLite, with its own ROUND) gives the same statement results."""
    from engine_crosscheck import crosscheck

    report = crosscheck(spark, SF_SMALL)
    assert len(report) == 20 and sum(report.values()) == 0, report


def test_statements_as_spark_sql_text(spark):
    """The statements written as Spark SQL over the registered views give the DataFrame results."""
    from engine_crosscheck import sparksql_crosscheck

    report = sparksql_crosscheck(spark, SF_SMALL)
    assert len(report) == 21 and sum(report.values()) == 0, report


def test_oracle_parity_on_empty_inputs(spark, tmp_out):
    """Empty input tables (same schemas): every query still agrees with its oracle (empty results,
    zero-filled fixed-domain matrices, KPI defaults)."""
    import pyarrow.parquet as pq

    from ladder.sources.tables import TABLES

    for t in TABLES:
        schema = pq.read_schema(f"{SF_SMALL}/{t}.parquet")
        pq.write_table(schema.empty_table(), os.path.join(tmp_out, f"{t}.parquet"))
    report = compare(spark, tmp_out, OWN)
    bad = {k: v["status"] for k, v in report.items() if v["status"] != "ok"}
    assert not bad, bad
    kpi = QUERIES["summary_kpis"](spark, tmp_out).first()
    assert (kpi.income_gap, kpi.asset_gap, kpi.upper_retention, kpi.latest_year) == (0.0, 0.0, 0.0, None)


def test_fused_refresh_equals_independent_results(spark):
    """The latest-year statements of a refresh come from one pass, and every result of the refresh (statements,
    matrices, charts, KPIs) equals the independently planned one."""
    from ladder.plans.dashboard import dashboard, shared_statements
    from ladder.plans.fused import fused_statements

    q = QUERIES
    independent = {n: sorted(map(str, fn(spark, SF_SMALL).collect())) for n, fn in q.items()}
    with shared_statements(spark, SF_SMALL) as run:
        res = dashboard(spark, run)
        plan = res["wage_by_education"]._jdf.queryExecution().executedPlan().toString()
        shared = {n: sorted(map(str, df.collect())) for n, df in res.items()}
    assert shared == independent
    assert "InMemoryTableScan" in plan
    assert len(fused_statements(spark, SF_SMALL)) == 12


def test_a_refresh_keeps_every_order(spark):
    """All results of a refresh, in their declared order, row by row as the lean plans give them (O1, O2)."""
    from ladder.plans.dashboard import dashboard, shared_statements

    lean = {n: [tuple(r) for r in fn(spark, SF_SMALL).collect()] for n, fn in QUERIES.items()}
    with shared_statements(spark, SF_SMALL) as run:
        shared = {n: [tuple(r) for r in df.collect()] for n, df in dashboard(spark, run).items()}
    assert len(shared) == 44
    for n, fn in QUERIES.items():
        ordered = bool(fn.order)
        assert (shared[n] == lean[n]) if ordered else (sorted(map(repr, shared[n])) == sorted(map(repr, lean[n]))), n


def test_the_document_reads_each_input_once(spark):
    df = QUERIES["dashboard_document"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()  # the final and the initial plan
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x]
    assert sum("l_extendedprice#" in x for x in scans) == 2
    assert scans and not any("household_id#" in x or "h_total_income#" in x for x in scans)  # only the panel's stored state


def test_low_group_escape_plus_stay_is_100(spark):
    from pyspark.sql import functions as F

    from ladder.operators import rate_by
    from ladder.sources import views

    p = views.panel(spark, SF_SMALL).where(
        (F.col("year_gap") == 1) & F.col("prev_income_decile").isNotNull() & F.col("h_incomeq").isNotNull())
    prev, cur = F.col("prev_income_decile"), F.col("h_incomeq")
    rates = rate_by(p, "year", {"escape": ((prev <= 3) & (cur > 3), prev <= 3),
                                "stay": ((prev <= 3) & (cur <= 3), prev <= 3)}).collect()
    assert rates and all(abs(r.escape + r.stay - 100.0) <= 0.1 for r in rates if r.escape is not None)
    trend = {r.year: r.lower_escape_rate for r in QUERIES["escape_and_retention_trend"](spark, SF_SMALL).collect()}
    assert {r.year: r.escape for r in rates} == trend


def _windows_without_partitions(node):
    """Yield (WindowExec, subtree text) for windows with no partition keys (or only literal ones)."""
    if node.nodeName() == "Window":
        spec = node.partitionSpec()
        keys = [spec.apply(i) for i in range(spec.size())]
        if all(k.foldable() for k in keys):
            yield node, node.treeString()
    children = node.children()
    for i in range(children.size()):
        yield from _windows_without_partitions(children.apply(i))


def test_unpartitioned_windows_only_over_aggregated_rows(spark):
    """SURVEY §5: a single-partition window may only run over an aggregated result, never over rows
    of a scanned table."""
    seen = 0
    for name, fn in QUERIES.items():
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().sparkPlan()
        for _, tree in _windows_without_partitions(plan):
            seen += 1
            lines = tree.splitlines()[1:]
            first_agg = next((i for i, ln in enumerate(lines) if "Aggregate" in ln), None)
            first_scan = next((i for i, ln in enumerate(lines) if "Scan" in ln and "LocalTableScan" not in ln), None)
            assert first_agg is not None and (first_scan is None or first_agg < first_scan), (name, tree)
    assert seen > 0


def test_the_same_plans_without_any_broadcast(spark, tmp_out):
    """As at cluster scale: no automatic broadcast joins, views rebuilt, the same results. The plans don't
    look at sizes, so only Spark's join strategies change."""
    for t in ("nation", "customer", "supplier", "orders", "lineitem"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", tmp_out)  # another path: the derived tables are built anew
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["expected_rate_by_income_band"](spark, tmp_out)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "_sxw" in plan and "Broadcast" not in plan
        names = ["expected_rate_by_income_band", "income_by_decile", "child_education_chart", "income_transition_chart",
                 "debt_by_generation_pivot", "summary_kpis", "spend_band_endpoints"]
        got = {n: [tuple(r) for r in QUERIES[n](spark, tmp_out).collect()] for n in names}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {n: [tuple(r) for r in QUERIES[n](spark, SF_SMALL).collect()] for n in names}


def test_building_plans_starts_no_job_beyond_the_derived_tables(spark):
    for fn in QUERIES.values():
        fn(spark, SF_SMALL)  # the derived tables are there now
    spark.sparkContext.setJobGroup("planning", "")
    try:
        for name in ("expected_rate_by_income_band", "dashboard_document", "education_firm_size_matrix"):
            QUERIES[name](spark, SF_SMALL)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    stages = [spark.sparkContext.statusTracker().getJobInfo(j) for j in jobs]
    # Reading a Parquet file's schema is a one-task job; nothing else runs.
    assert all(len(s.stageIds) == 1 for s in stages if s)


def test_results_scan_their_input_once(spark):
    once = ["education_employment_matrix", "education_firm_size_matrix", "education_employment_chart",
            "education_firm_size_chart", "debt_by_generation_matrix", "debt_by_generation_chart",
            "child_education_matrix", "child_education_chart", "transition_summary"]
    for name in once:
        df = QUERIES[name](spark, SF_SMALL)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().executedPlan().toString().split("== Initial Plan ==")[0]
        scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "panel_periods" not in x]
        assert len(scans) == 1, (name, plan)


def test_latest_year_reads_a_table(spark):
    df = QUERIES["latest_year"](spark, SF_SMALL)
    assert "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()


def test_json_sink_keeps_nulls_and_does_not_nest_documents(spark, tmp_out):
    from ladder.sources import write_dashboard

    paths = write_dashboard(spark, SF_SMALL, tmp_out, queries={
        k: QUERIES[k] for k in ("employment_mobility_share", "income_transition_chart", "dashboard_document")})
    rows = [json.loads(r.value) for r in spark.read.text(paths["employment_mobility_share"]).collect()]
    assert any("employment_label" in r and r["employment_label"] is None for r in rows)
    doc = [json.loads(r.value) for r in spark.read.text(paths["income_transition_chart"]).collect()]
    assert len(doc) == 1 and len(doc[0]["values"]) == 10 and doc[0]["raw"]
    whole = json.loads(spark.read.text(paths["dashboard_document"]).first().value)
    assert whole["kpis"]["latest_year"] and whole["charts"]["income_transition_chart"] == doc[0]
    assert len(whole["charts"]) == 19


def test_records_equal_pandas_record_encoding(spark):
    """One JSON object per row, as a pandas records encoding with non-ASCII kept gives them."""
    from ladder.sources import to_records

    df = QUERIES["employment_mobility_share"](spark, SF_SMALL)   # has NULL labels (code 9)
    ours = [json.loads(r.record) for r in to_records(df).collect()]
    theirs = json.loads(df.toPandas().to_json(orient="records", force_ascii=False))
    assert ours == theirs
    assert any(rec["employment_label"] is None for rec in ours)


def test_chart_equals_pandas_pivot_of_the_flat_result(spark):
    """R4 on the trickiest case (observed columns, label-keyed rows, NULL labels dropped): our chart
    document equals a pandas pivot_table / reindex / fillna of the flat statement result."""
    from ladder.functions.labels import EDU_LABELS, EDU_ORDER, EMPLOYMENT_TYPE_LABELS

    q = QUERIES
    flat = q["education_employment_share"](spark, SF_SMALL).toPandas()
    rows = [EDU_LABELS[x] for x in EDU_ORDER]
    pivot = (flat.pivot_table(index="education_label", columns="employment_type", values="share", aggfunc="sum")
             .reindex(index=rows).fillna(0))
    expect = {"labels": rows,
              "datasets": [{"label": EMPLOYMENT_TYPE_LABELS.get(int(c), str(c)),
                            "data": [float(v) for v in pivot[c].tolist()]} for c in pivot.columns]}
    chart = json.loads(q["education_employment_chart"](spark, SF_SMALL).first().chart)
    assert chart == expect


def test_transition_matrix_document_equals_pandas_reindex(spark):
    """R4 matrix form: the 10 x 10 document equals a pandas pivot of the flat transition shares,
    reindexed to deciles 1..10 on both axes with zeros filled."""
    q = QUERIES
    flat = q["income_transition_matrix"](spark, SF_SMALL).toPandas()
    levels = list(range(1, 11))
    pivot = (flat.pivot_table(index="prev_decile", columns="cur_decile", values="share", aggfunc="sum")
             .reindex(index=levels, columns=levels, fill_value=0).fillna(0))
    expect = {"rows": [str(x) for x in levels], "columns": [str(x) for x in levels],
              "values": [[float(v) for v in row] for row in pivot.values.tolist()],
              "raw": json.loads(flat.to_json(orient="records", force_ascii=False))}
    assert json.loads(q["income_transition_chart"](spark, SF_SMALL).first().matrix) == expect


def test_child_education_chart_equals_pandas_fixed_domain_pivot(spark):
    """R4 with fixed domains (5 quintiles x 6 education codes) and code labels with fallback."""
    from ladder.functions.labels import PARENT_EDU_LABELS

    q = QUERIES
    flat = q["child_education_share"](spark, SF_SMALL).toPandas()
    rows, cols = [1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6]
    pivot = (flat.pivot_table(index="quintile", columns="child_edu", values="share", aggfunc="sum")
             .reindex(index=rows, columns=cols, fill_value=0).fillna(0))
    expect = {"labels": [str(x) for x in rows],
              "datasets": [{"label": str(PARENT_EDU_LABELS.get(int(c), c)),
                            "data": [float(v) for v in pivot[c].tolist()]} for c in cols],
              "raw": json.loads(flat.to_json(orient="records", force_ascii=False))}
    assert json.loads(q["child_education_chart"](spark, SF_SMALL).first().chart) == expect
