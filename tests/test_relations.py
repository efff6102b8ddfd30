"""The caller's own relations: column mapping, types, quarantine, and the statements over them."""

import datetime
import json

import pytest
from oracle_compare import compare
from pyspark.sql import functions as F
from support import SF_SMALL

from ladder.operators import transition_matrix
from ladder.plans import own
from ladder.plans.queries import QUERIES
from ladder.sources import conform, own_relations, views
from ladder.sources.relations import RELATIONS, with_household_row
from ladder.sources.store import write_scratch


def test_own_queries_equal_their_sql(spark):
    report = compare(spark, SF_SMALL, list(own.QUERIES))
    assert not {k: v["status"] for k, v in report.items() if v["status"] != "ok"}
    assert len(report) == len(own.STATEMENTS) + 1 and report["own_quarantine"]["rows"] == (2, 2)


def test_every_statement_runs_on_own_relations_and_agrees(spark):
    """Renamed and as text, but nothing spoilt: all 44 results equal those over the views."""
    sf = {n: getattr(views, n)(spark, SF_SMALL) for n in RELATIONS}
    panel = sf["panel"].drop("household_row").select(
        *[F.col(c).cast("string").alias(own.PANEL_NAMES.get(c, c)) for c in sf["panel"].columns if c != "household_row"])
    run = own_relations(spark, {**sf, "panel": panel}, columns={"panel": own.PANEL_NAMES}, city=1)
    assert run.quarantine.count() == 0
    for name, fn in QUERIES.items():
        assert [tuple(r) for r in fn(spark, run).collect()] == [tuple(r) for r in fn(spark, SF_SMALL).collect()], name


def test_values_that_do_not_fit_go_to_the_quarantine(spark):
    rows = [("1", "2020", " 3 ", "12.5"), ("2", "2020.0", "3.9", "1e3"), ("x", "2020", "3", "1"), ("4", "2020.5", "", None),
            ("9007199254740993", "2021", None, ""), ("5", "99999999999", "abc", "NaN"), ("6", None, "4", "-")]
    df = spark.createDataFrame(rows, "id string, `y``r` string, `h.q` string, `소득 %` string")
    for c in RELATIONS["panel"].names:
        if c not in ("household_id", "year", "h_incomeq", "h_total_income"):
            df = df.withColumn(c, F.lit(None).cast("string"))
    names = {"household_id": "id", "year": "y`r", "h_incomeq": "h.q", "h_total_income": "소득 %"}
    got = conform(df, "panel", names).select("household_id", "year", "h_incomeq", "h_total_income", "_misfits", "_record").collect()
    assert [tuple(r[:4]) for r in got[:2]] == [(1, 2020, 3.0, 12.5), (2, 2020, 3.9, 1000.0)]
    assert [r._misfits for r in got] == [[], [], ["household_id: x"], ["year: 2020.5"], [], ["year: 99999999999", "h_incomeq: abc"],
                                        ["h_total_income: -"]]
    assert got[4].household_id == 9007199254740993 and got[4].h_total_income is None and got[4]._record is None
    assert json.loads(got[6]._record)["소득 %"] == "-" and json.loads(got[6]._record)["y`r"] is None
    run = own_relations(spark, {"panel": df}, {"panel": names})
    assert run.quarantine.count() == 4 and QUERIES["latest_year"](spark, run).first()[0] == 2021


def test_wrong_relations_are_refused(spark):
    df = spark.createDataFrame([(1, 1.0, datetime.date(2020, 1, 1))], "student_id long, parent_quintile double, d date")
    with pytest.raises(ValueError, match="unknown relation"):
        conform(df, "people")
    with pytest.raises(ValueError, match="no columns .*child_edu"):
        conform(df, "parent_child")
    with pytest.raises(ValueError, match="has no columns .'x'"):
        conform(df, "parent_child", {"x": "d"})
    with pytest.raises(ValueError, match="date column 'd' can't be int"):
        conform(df, "parent_child", {"child_edu": "d", "is_grad": "student_id"})
    with pytest.raises(ValueError, match="not given"):
        own_relations(spark, {}, {"panel": {}})
    run = own_relations(spark, {"institution": spark.createDataFrame([("a", "1", "5%")], "name string, city string, rate_text string")})
    with pytest.raises(ValueError, match="'panel' was not given"):
        QUERIES["income_by_decile"](spark, run)


def test_the_marker_counts_what_distinct_counts(spark):
    rows = []
    for h in [None, 1, 1, 1, 2, 3, 3, 4, 5, 5, 5, 6, 7, 7]:
        for y in (2020, 2021):
            rows.append((h, y, [3.0, 3.7, 10.5, 10.0, None][len(rows) % 5], [1.0, 2.0, None][len(rows) % 3], [1, 1, 2, None][len(rows) % 4]))
    df = spark.createDataFrame(rows, "household_id long, year int, h_incomeq double, prev_income_decile double, year_gap int")
    for f in RELATIONS["panel"].fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    marked = with_household_row(write_scratch(df.repartition(3)))
    assert marked.count() == len(rows) and marked.where("household_id IS NULL AND household_row").count() == 0
    want = sorted(map(tuple, transition_matrix(df).collect()))
    assert sorted(map(tuple, transition_matrix(marked, marker="household_row").collect())) == want and want


def test_the_matrix_moves_only_counts(spark):
    df = QUERIES["income_transition_matrix"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().executedPlan().toString().split("== Initial Plan ==")[0]
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and not any("household_id" in x for x in exchanges)
    assert plan.count("FileScan parquet") == 1


def test_empty_relations(spark):
    run = own_relations(spark, {n: spark.createDataFrame([], s) for n, s in RELATIONS.items()}, city=1)
    assert QUERIES["income_by_decile"](spark, run).count() == 0 and run.quarantine.count() == 0
    kpi = QUERIES["summary_kpis"](spark, run).first()
    assert (kpi.income_gap, kpi.upper_retention, kpi.latest_year) == (0.0, 0.0, None)
