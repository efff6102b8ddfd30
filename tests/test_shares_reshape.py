import json


from ladder.operators import dense_grid, dense_long, dense_pivot, share_of_total, share_within, to_chart, to_matrix


def _shares_small(spark):
    rows = [(1, 1)] * 3 + [(1, 2)] + [(1, 9)] * 4 + [(2, 2)] * 2 + [(2, None)] + [(None, 1)]
    return spark.createDataFrame(rows, "g int, c int")


def test_share_within_uses_all_categories_as_denominator(spark):
    out = {(r.g, r.c): (r.n, r.share) for r in share_within(_shares_small(spark), "g", "c").collect()}
    assert out[(1, 1)] == (3, 37.5) and out[(1, 9)] == (4, 50.0) and out[(1, 2)] == (1, 12.5)
    assert out[(2, 2)] == (2, 66.7) and out[(2, None)] == (1, 33.3)
    assert out[(None, 1)] == (1, 100.0)


def test_share_of_total(spark):
    out = {r.c: r.share for r in share_of_total(_shares_small(spark), "c").collect()}
    assert out == {1: 33.3, 2: 25.0, 9: 33.3, None: 8.3}


def test_dense_pivot_fixed_domains_fill_and_drop(spark):
    flat = share_within(_shares_small(spark), "g", "c")
    wide = dense_pivot(flat, "g", "c", "share", rows=[1, 2, 3], cols=[1, 2, 3]).orderBy("_row_pos")
    got = [tuple(r) for r in wide.collect()]
    # unlisted category 9 dropped, missing category 3 and missing row 3 filled with 0, NULL keys dropped
    assert got == [(1, 1, 37.5, 12.5, 0.0), (2, 2, 0.0, 66.7, 0.0), (3, 3, 0.0, 0.0, 0.0)]


def test_dense_pivot_observed_columns(spark):
    flat = share_within(_shares_small(spark), "g", "c")
    wide = dense_pivot(flat, "g", "c", "share", rows=[1, 2])
    assert [c for c in wide.columns if c not in ("g", "_row_pos")] == ["1", "2", "9"]


def test_dense_pivot_matches_pandas(spark):
    flat = share_within(_shares_small(spark), "g", "c")
    pdf = flat.toPandas()
    expect = (pdf.pivot_table(index="g", columns="c", values="share", aggfunc="sum")
              .reindex(index=[1, 2, 3], columns=[1, 2, 3], fill_value=0).fillna(0))
    wide = dense_pivot(flat, "g", "c", "share", rows=[1, 2, 3], cols=[1, 2, 3]).orderBy("_row_pos").toPandas()
    assert wide[["1", "2", "3"]].to_numpy().tolist() == expect.to_numpy().tolist()


def test_dense_long_labels_with_fallback(spark):
    flat = share_within(_shares_small(spark), "g", "c")
    m = dense_long(flat, "g", "c", "share", rows=[1, 2], cols=[1, 2, 7], col_labels={1: "one", 2: "two"})
    got = {(r.row_label, r.col_label): r.value for r in m.collect()}
    assert got[("1", "one")] == 37.5 and got[("2", "7")] == 0.0 and len(got) == 6


def test_to_chart_and_to_matrix(spark):
    flat = share_within(_shares_small(spark), "g", "c")
    m = dense_grid(flat, "g", "c", "share", rows=[1, 2], cols=[1, 2], row_labels={1: "r1"}, col_labels={2: "c2"})
    chart = json.loads(to_chart(m).selectExpr("to_json(chart)").first()[0])
    assert chart == {"labels": ["r1", "2"], "datasets": [{"label": "1", "data": [37.5, 0.0]},
                                                         {"label": "c2", "data": [12.5, 66.7]}]}
    matrix = json.loads(to_matrix(m).selectExpr("to_json(matrix)").first()[0])
    assert matrix == {"rows": ["r1", "2"], "columns": ["1", "c2"], "values": [[37.5, 12.5], [0.0, 66.7]]}


def test_dense_pivot_mean_observed_rows(spark):
    df = spark.createDataFrame([(2001, "young", 2.0), (2000, "other", 9.0), (2001, "middle", 4.0)],
                               "year int, gen string, v double")
    wide = dense_pivot(df, "year", "gen", "v", cols=["young", "middle", "senior"], agg="mean").orderBy("_row_pos")
    assert [tuple(r) for r in wide.collect()] == [(2000, 1, 0.0, 0.0, 0.0), (2001, 2, 2.0, 4.0, 0.0)]


def test_documents_with_raw_rows_and_without_rows(spark):
    rows = [(2, "b", 1.0), (1, None, 5.0), (1, "a", None), (1, "z", 2.0)]
    df = spark.createDataFrame(rows, "g int, c string, v double")
    doc = json.loads(to_matrix(dense_grid(df, "g", "c", "v", cols=["a", "b"]), raw=True)
                     .selectExpr("to_json(matrix, map('ignoreNullFields', 'false'))").first()[0])
    assert doc["rows"] == ["1", "2"] and doc["values"] == [[0.0, 0.0], [0.0, 1.0]]
    assert doc["raw"] == [{"g": 1, "c": None, "v": 5.0}, {"g": 1, "c": "a", "v": None}, {"g": 1, "c": "z", "v": 2.0},
                          {"g": 2, "c": "b", "v": 1.0}]
    none = dense_grid(df.where("g > 9"), "g", "c", "v", rows=[1, 2], cols=["a"])
    assert json.loads(to_chart(none, raw=True, empty=True).selectExpr("to_json(chart)").first()[0]) == {
        "labels": [], "datasets": [], "raw": []}
    assert json.loads(to_chart(none).selectExpr("to_json(chart)").first()[0]) == {
        "labels": ["1", "2"], "datasets": [{"label": "a", "data": [0.0, 0.0]}]}


def test_a_grid_reads_its_input_once(spark, tmp_out):
    spark.createDataFrame([(1, 2, 3.0)], "g int, c int, v double").write.parquet(tmp_out + "/t")
    df = spark.read.parquet(tmp_out + "/t")
    for kw in ({}, {"rows": [1]}, {"cols": [1]}, {"rows": [1], "cols": [2]}):
        m = dense_long(df, "g", "c", "v", **kw)
        m.collect()
        assert m._jdf.queryExecution().executedPlan().executedPlan().toString().count("FileScan parquet") == 1
