"""Reading, stacking and saving tables."""

from rollcall.sources import PERIOD_SCHEMAS, load_result, read_csv, read_sheets, save_result, stack_periods


def test_csv_with_schema_and_na(spark, tmp_path):
    path = tmp_path / "att.csv"
    path.write_text("study_period,entity,age,rank\nm19,x,12,1\nm19,y,NA,2\n")
    rows = read_csv(spark, str(path), PERIOD_SCHEMAS["att"]).orderBy("rank").collect()
    assert [tuple(r) for r in rows] == [("m19", "x", 12, 1), ("m19", "y", None, 2)]


def test_sheets_are_stacked_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("entity,presence\nx,1\n")
    (tmp_path / "b.csv").write_text("entity,presence\ny,0\nz,NA\n")
    sheets = read_sheets(spark, {k: str(tmp_path / f"{k}.csv") for k in "ab"}, "entity string, presence int")
    sheets["b"] = sheets["b"].withColumnRenamed("presence", "other")
    out = {(r.period, r.entity): (r.presence, r.other) for r in stack_periods(sheets).collect()}
    assert out == {("a", "x"): (1, None), ("b", "y"): (None, 0), ("b", "z"): (None, None)}


def test_results_are_kept_and_pruned(spark, tmp_path):
    path = str(tmp_path / "draws")
    df = spark.createDataFrame([(1, 1, "a", 0.5), (2, 1, "a", 0.7)], PERIOD_SCHEMAS["draws"])
    save_result(df, path, "chain")
    back = load_result(spark, path)
    assert back.filter("chain = 2").first().value == 0.7
    assert "PartitionFilters: [isnotnull(chain" in back.filter("chain = 2")._jdf.queryExecution().executedPlan().toString()
    sheets = read_sheets(spark, {"d": path}, fmt="parquet")
    assert sheets["d"].count() == 2
