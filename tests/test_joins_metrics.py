
from ladder.functions.labels import EDU_LABELS, EDU_ORDER
from ladder.functions import rank_of
from ladder.operators import (
    attach_scalar,
    extremes,
    interpolate_two_tiers,
    label_of,
    summary_kpis,
    tier_means,
    transition_summary,
)


def test_label_lookup_and_fallback(spark):
    df = spark.createDataFrame([(1,), (9,), (None,)], "code int")
    m = {1: "one", 2: "two"}
    rows = df.select(label_of("code", m).alias("a"), label_of("code", m, fallback=True).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [("one", "one"), (None, "9"), (None, None)]


def test_attach_scalar_empty_row_empties_result(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    one = spark.createDataFrame([(5.0,)], "v double")
    assert [tuple(r) for r in attach_scalar(df, one).orderBy("x").collect()] == [(1, 5.0), (2, 5.0)]
    assert attach_scalar(df, one.where("v < 0")).count() == 0


RATES = ["-", "68.5%", "", None, " 70 ", "1e2x", "-3.5", "abc", ".5", "+7", "68.0"]


def test_tiers_and_interpolation(spark):
    inst = spark.createDataFrame([(r,) for r in RATES], "rate_text string")
    tiers = {r.tier: r.tier_rate for r in tier_means(inst).collect()}
    high = [68.5, 70.0, 100.0, 68.0]
    normal = [0.0, -3.5, 0.0, 0.5, 7.0]   # '-' and 'abc' count as 0; '' and NULL are filtered out
    assert tiers["High_Tier"] == sum(high) / len(high)
    assert abs(tiers["Normal_Tier"] - sum(normal) / len(normal)) < 1e-12
    bands = spark.createDataFrame([(1, 10.0), (2, 20.0), (None, 5.0)], "band int, spend double")
    out = {r.band: (r.spend, r.expected_rate) for r in
           interpolate_two_tiers(bands, tier_means(inst), "band", "spend").collect()}
    h, n = tiers["High_Tier"], tiers["Normal_Tier"]
    assert out[2] == (20.0, round(h, 1))
    assert out[1][1] == round(0.5 * h + 0.5 * n, 1)
    assert None in out
    no_high = spark.createDataFrame([("10",), ("20",)], "rate_text string")
    assert interpolate_two_tiers(bands, tier_means(no_high), "band", "spend").count() == 0


def test_summary_kpis_zero_guards(spark):
    inc = spark.createDataFrame([(100.0,), (300.0,)], "v double")
    ast = spark.createDataFrame([(0.0,), (0.0,)], "v double")
    ret = spark.createDataFrame([(None,)], "r double")
    yr = spark.createDataFrame([(2001,)], "y int")
    row = summary_kpis(inc, "v", ast, "v", ret, "r", yr, "y").first()
    assert (row.income_gap, row.asset_gap, row.upper_retention, row.latest_year) == (3.0, 0.0, 0.0, 2001)
    empty = spark.createDataFrame([], "v double")
    row = summary_kpis(empty, "v", empty, "v", ret, "r", yr, "y").first()
    assert (row.income_gap, row.asset_gap) == (0.0, 0.0)
    ast2 = spark.createDataFrame([(0.0,), (10.0,), (40.0,)], "v double")
    assert summary_kpis(inc, "v", ast2, "v", ret, "r", yr, "y").first().asset_gap == 4.0


def test_extremes_first_occurrence_on_ties(spark):
    rows = [("college", 5.0), ("elementary", 5.0), ("university", 9.0), ("middle_school", 9.0)]
    df = spark.createDataFrame(rows, "education_group string, wage double").withColumn(
        "label", label_of("education_group", EDU_LABELS))
    r = extremes(df, "label", "wage", rank_of("education_group", EDU_ORDER)).first()
    assert (r.lowest_label, r.lowest_value) == (EDU_LABELS["elementary"], 5.0)
    assert (r.highest_label, r.highest_value) == (EDU_LABELS["middle_school"], 9.0)
    assert extremes(df.limit(0), "label", "wage", rank_of("education_group", EDU_ORDER)).count() == 0


def test_transition_summary(spark):
    cells = [(i, str(i), j, str(j), float(10 * i if i == j else 0)) for i in range(1, 11) for j in range(1, 11)]
    m = spark.createDataFrame(cells, "row_pos int, row_label string, col_pos int, col_label string, value double")
    r = transition_summary(m).first()
    assert (r.avg_stay, r.lower_stay, r.upper_stay) == (55.0, 10.0, 100.0)
    assert transition_summary(m.limit(0)).count() == 0


def test_endpoint_values_null_key_first(spark):
    from ladder.operators import endpoint_values

    df = spark.createDataFrame([(2, 20.0), (None, 5.0), (9, None), (1, 10.0)], "k int, v double")
    r = df.agg(*endpoint_values("k", {"v": "v"})).first()
    assert (r.v_first, r.v_last) == (5.0, None)
