"""Stored states: appended files are all a refresh reads, and results equal a full run's."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F
from support import SF_SMALL

from ladder.plans import incremental
from ladder.plans.incremental import StoredPanel
from ladder.plans.queries import QUERIES
from ladder.sources import own_relations, store, views

PANEL_STATEMENTS = [
    "income_by_decile", "asset_by_decile", "wage_by_education", "education_employment_share", "education_firm_size_share",
    "education_job_status_share", "wage_by_firm_size", "wage_by_job_status", "net_asset_by_job_status",
    "employment_mobility_share", "mobility_share", "upper_retention_kpi", "income_asset_change_by_decile",
    "asset_gap_ratio_trend", "debt_by_generation", "escape_and_retention_trend", "income_transition_matrix", "latest_year"]


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def by_year(spark, folder, years):
    for y in years:
        views.panel(spark, SF_SMALL).where(F.col("year") == y).coalesce(1).write.parquet(f"{folder}/part={y}")


def full(spark, folder):
    df = spark.read.parquet(folder).drop("part")
    run = own_relations(spark, {"panel": df.drop("household_row")})
    return {n: rows(QUERIES[n](spark, run, ordered=False)) for n in PANEL_STATEMENTS}


def test_statements_equal_a_full_run(spark, tmp_out):
    years = sorted(r.year for r in views.panel_periods(spark, SF_SMALL).collect())
    folder = f"{tmp_out}/panel"
    by_year(spark, folder, years[:-2])
    stored = StoredPanel(spark, folder, f"t-{os.path.basename(tmp_out)}")
    first = {n: rows(df) for n, df in stored.statements().items()}
    assert set(first) == set(PANEL_STATEMENTS) and first == full(spark, folder)
    by_year(spark, folder, years[-2:])  # files appended
    second = {n: rows(df) for n, df in stored.statements().items()}
    assert second == full(spark, folder) and second != first
    again = {n: rows(df) for n, df in stored.statements().items()}  # nothing new
    assert again == second and len(stored._manifest()[1]) == 2
    shutil.rmtree(f"{folder}/part={years[0]}")  # a file removed takes its batch with it
    third = {n: rows(df) for n, df in stored.statements().items()}
    assert third == full(spark, folder) and third != second


def test_only_new_files_are_read(spark, tmp_out, monkeypatch):
    years = sorted(r.year for r in views.panel_periods(spark, SF_SMALL).collect())
    folder = f"{tmp_out}/panel"
    by_year(spark, folder, years[:-1])
    stored = StoredPanel(spark, folder, f"n-{os.path.basename(tmp_out)}")
    stored.refresh()
    by_year(spark, folder, years[-1:])
    read = []
    old = incremental.StoredPanel._read

    def spy(self, df, paths):
        out = old(self, df, paths)
        read.append((paths, sorted(out.inputFiles())))
        return out

    monkeypatch.setattr(incremental.StoredPanel, "_read", spy)
    stored.refresh()
    (paths, scanned), = read
    assert len(paths) == 1 and f"part={years[-1]}" in paths[0] and [p.split("file:")[1].lstrip("/") for p in scanned] == [
        p.split("file:")[1].lstrip("/") for p in paths]
    read.clear()
    stored.refresh()
    assert read == []


def test_the_event_log_shows_only_the_new_files_rows(spark, tmp_out):
    """Rows read by a refresh after an append: those of the appended file (and the stored states), not the panel's."""
    import subprocess
    import sys

    years = sorted(r.year for r in views.panel_periods(spark, SF_SMALL).collect())
    folder, log = f"{tmp_out}/panel", f"{tmp_out}/log"
    by_year(spark, folder, years)
    os.makedirs(log)
    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
import shutil
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
         .config("spark.eventLog.dir", "file://{log}").config("spark.eventLog.compress", "false")
         .config("spark.eventLog.rolling.enabled", "false")
         .config("spark.checkpoint.dir", "{tmp_out}/ck").config("spark.sql.shuffle.partitions", "2").getOrCreate())
from ladder.plans.incremental import StoredPanel
shutil.move("{folder}/part={years[-1]}", "{tmp_out}/later")
stored = StoredPanel(spark, "{folder}", "logged")
stored.refresh()
shutil.move("{tmp_out}/later", "{folder}/part={years[-1]}")
spark.sparkContext.setJobDescription("second")
stored.refresh()
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=240, capture_output=True)
    events = [json.loads(x) for x in open(f"{log}/{os.listdir(log)[0]}")]
    stages = {s for e in events if e["Event"] == "SparkListenerJobStart"
              and (e.get("Properties") or {}).get("spark.job.description") == "second" for s in e["Stage IDs"]}
    read = sum(e["Task Metrics"]["Input Metrics"]["Records Read"] for e in events
               if e["Event"] == "SparkListenerTaskEnd" and e["Stage ID"] in stages and e.get("Task Metrics"))
    n = spark.read.parquet(f"{folder}/part={years[-1]}").count()
    # the cells and the household moves are two scans of the new file
    assert n <= read <= 2 * n < spark.read.parquet(folder).count()


def test_batches_merge_and_refreshes_race(spark, tmp_out, monkeypatch):
    years = sorted(r.year for r in views.panel_periods(spark, SF_SMALL).collect())
    folder = f"{tmp_out}/panel"
    monkeypatch.setattr(incremental, "MOST_BATCHES", 2)
    stored = StoredPanel(spark, folder, f"m-{os.path.basename(tmp_out)}")
    for y in years[:4]:
        by_year(spark, folder, [y])
        stored.refresh()
    assert len(stored._manifest()[1]) <= 2
    by_year(spark, folder, years[4:5])
    other, old, calls = StoredPanel(spark, folder, f"m-{os.path.basename(tmp_out)}"), incremental.write_json, []

    def raced(*args, **named):
        if not calls:
            calls.append(1)
            other.refresh()  # takes the number first
        return old(*args, **named)

    monkeypatch.setattr(incremental, "write_json", raced)
    got = {n: rows(df) for n, df in stored.statements().items()}
    assert got == full(spark, folder)
    files = [tuple(f) for b in stored._manifest()[1] for f in b["files"]]
    assert len(files) == len(set(files)) == 5  # each file counted once


def test_foreign_columns_and_an_empty_folder(spark, tmp_out):
    src = views.panel(spark, SF_SMALL).drop("household_row").withColumnRenamed("h_total_income", "소득")
    src = src.withColumn("소득", F.when(F.col("household_id") % 50 == 1, F.lit("?")).otherwise(F.col("소득").cast("string")))
    src.limit(0).write.parquet(f"{tmp_out}/p")
    stored = StoredPanel(spark, f"{tmp_out}/p", f"f-{os.path.basename(tmp_out)}", {"h_total_income": "소득"})
    assert stored.statements()["income_by_decile"].count() == 0
    src.repartition(3).write.mode("append").parquet(f"{tmp_out}/p")
    got = rows(stored.statements()["income_by_decile"])
    run = own_relations(spark, {"panel": src}, {"panel": {"h_total_income": "소득"}})
    assert got == rows(QUERIES["income_by_decile"](spark, run)) and got
    assert store.path_exists(spark, stored.root)


@pytest.mark.parametrize("name", ["incremental_income_by_decile", "incremental_escape_and_retention_trend"])
def test_registered_queries(spark, name):
    from oracle_compare import compare

    assert compare(spark, SF_SMALL, [name])[name]["status"] == "ok"
