import random

import pytest
from pyspark.sql import functions as F

from ladder.operators import (
    change_between_endpoints,
    escape_and_retention,
    group_ratio_trend,
    transition_matrix,
    upper_retention,
)
from ladder.functions import int_code
from ladder.sources.views import PANEL_SCHEMA, PANEL_COLUMNS


def panel_rows(rows):
    """Rows given as dicts with a subset of panel columns; the rest NULL."""
    return [tuple(r.get(c) for c in PANEL_COLUMNS) for r in rows]


def small_panel(spark):
    rows = [
        # one household, two persons, identical household attributes: counted once after DISTINCT
        dict(household_id=1, person_no=1, year=2001, h_incomeq=5.0, prev_income_decile=2.0, year_gap=1, h_total_asset=10.0),
        dict(household_id=1, person_no=2, year=2001, h_incomeq=5.0, prev_income_decile=2.0, year_gap=1, h_total_asset=10.0),
        dict(household_id=2, person_no=1, year=2001, h_incomeq=10.5, prev_income_decile=9.0, year_gap=1, h_total_asset=50.0),
        dict(household_id=3, person_no=1, year=2001, h_incomeq=10.0, prev_income_decile=10.0, year_gap=1, h_total_asset=40.0),
        dict(household_id=4, person_no=1, year=2001, h_incomeq=9.0, prev_income_decile=2.0, year_gap=2, h_total_asset=30.0),
        dict(household_id=None, person_no=1, year=2001, h_incomeq=3.0, prev_income_decile=2.0, year_gap=1, h_total_asset=1.0),
        dict(household_id=1, person_no=1, year=2000, h_incomeq=2.0, year_gap=None, h_total_asset=4.0),
        dict(household_id=3, person_no=1, year=2000, h_incomeq=10.0, year_gap=None, h_total_asset=20.0),
    ]
    return spark.createDataFrame(panel_rows(rows), PANEL_SCHEMA)


def test_transition_matrix_dedupes_and_filters(spark):
    got = {(r.prev_decile, r.cur_decile): (r.n_households, r.share) for r in transition_matrix(small_panel(spark)).collect()}
    # hh1 counted once, hh2 (10.5) out, hh4 (gap 2) out, NULL household out
    assert got == {(2, 5): (1, 100.0), (10, 10): (1, 100.0)}
    got_persons = {(r.prev_decile, r.cur_decile): r.n_households
                   for r in transition_matrix(small_panel(spark), dedupe=False).collect()}
    assert got_persons == {(2, 5): 2, (10, 10): 1}


def test_escape_and_retention(spark):
    got = {r.year: (r.lower_escape_rate, r.upper_retention_rate) for r in escape_and_retention(small_panel(spark)).collect()}
    # gap = 1 rows of 2001: low group = hh1 x2 (2 -> 5, escaped), NULL hh (2 -> 3, stays low);
    # high group = hh2 (9 -> 10.5), hh3 (10 -> 10). Person grain, no de-duplication.
    assert got == {2001: (66.7, 100.0)}


def test_upper_retention_kpi_and_empty_default(spark):
    assert upper_retention(small_panel(spark)).first().upper_retention == 100.0
    empty = spark.createDataFrame([], PANEL_SCHEMA)
    assert upper_retention(empty).first().upper_retention == 0.0


def test_change_between_endpoints_single_year_and_missing_end(spark):
    p = small_panel(spark)
    base = p.where(F.col("h_incomeq").between(1, 10))
    got = {r.decile: r.asset for r in change_between_endpoints(
        base, "year", int_code("h_incomeq").alias("decile"), {"h_total_asset": "asset"}, source=p).collect()}
    assert got[10] == 100.0   # 20 -> 40
    assert got[5] is None     # only in the last year
    one_year = p.where(F.col("year") == 2001)
    same = change_between_endpoints(one_year, "year", int_code("h_incomeq").alias("d"), {"h_total_asset": "a"})
    assert {r.a for r in same.collect()} == {0.0}


def test_group_ratio_trend_excludes_non_integer_and_zero_bottom(spark):
    rows = [dict(year=1, h_incomeq=10.0, h_total_asset=30.0), dict(year=1, h_incomeq=1.0, h_total_asset=10.0),
            dict(year=1, h_incomeq=10.5, h_total_asset=1e9), dict(year=2, h_incomeq=10.0, h_total_asset=5.0),
            dict(year=2, h_incomeq=1.0, h_total_asset=0.0)]
    df = spark.createDataFrame(panel_rows(rows), PANEL_SCHEMA)
    got = {r.year: r.ratio for r in group_ratio_trend(df, "year", "h_incomeq", "h_total_asset").collect()}
    assert got == {1: 3.0, 2: None}


def _random_panel(spark, seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append(dict(household_id=rnd.choice([None] + list(range(40))), person_no=rnd.randint(1, 3),
                         year=rnd.randint(2000, 2004), h_incomeq=float(rnd.randint(1, 10)),
                         prev_income_decile=rnd.choice([None, float(rnd.randint(1, 10))]),
                         year_gap=rnd.choice([1, 1, 2, None])))
    return spark.createDataFrame(panel_rows(rows), PANEL_SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_transition_matrix_against_pandas(spark, seed):
    p = _random_panel(spark, seed)
    pdf = p.toPandas()
    base = pdf[(pdf.year_gap == 1) & pdf.household_id.notna() & pdf.prev_income_decile.between(1, 10)
               & pdf.h_incomeq.between(1, 10)].copy()
    base["prev"] = base.prev_income_decile.astype(int)
    base["cur"] = base.h_incomeq.astype(int)
    base = base[["household_id", "year", "prev", "cur"]].drop_duplicates()
    counted = base.groupby(["prev", "cur"]).size().rename("n").reset_index()
    counted["share"] = (counted.n * 100.0 / counted.groupby("prev").n.transform("sum"))
    got = {(r.prev_decile, r.cur_decile): (r.n_households, r.share) for r in transition_matrix(p).collect()}
    expect = {(int(a), int(b)): (int(n), s) for a, b, n, s in counted.itertuples(index=False)}
    assert set(got) == set(expect)
    for k, (n, s) in expect.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(s, abs=0.0501)
    # property: each previous decile's row sums to 100 up to rounding
    by_prev = {}
    for (a, _), (_, s) in got.items():
        by_prev[a] = by_prev.get(a, 0.0) + s
    assert all(abs(v - 100.0) <= 0.1 * 10 for v in by_prev.values())


def test_period_filters_take_bounds_from_the_whole_source(spark):
    from ladder.operators import endpoints, latest_period

    df = spark.createDataFrame([(1999, 1.0), (2000, 2.0), (2001, None), (2002, 4.0)], "year int, x double")
    filtered = df.where(F.col("x").isNotNull() & (F.col("year") < 2002))
    # bounds from the whole table (2002), not from the filtered rows: nothing survives
    assert latest_period(filtered, "year", source=df).count() == 0
    assert [r.year for r in latest_period(filtered, "year").collect()] == [2000]
    assert sorted(r.year for r in endpoints(df, "year").collect()) == [1999, 2002]
