from procspark.sources import layout


def test_months_are_pruned(spark, tmp_path):
    rows = [(i % 3, i, f"2026-{1 + i % 4:02d}-05") for i in range(40)]
    df = spark.createDataFrame(rows, "vendor_id int, n int, ts string").selectExpr("vendor_id", "n", "cast(ts as timestamp_ntz) ts")
    layout.write_by_month(df, str(tmp_path / "t"), 2)
    got = layout.read_months(spark, str(tmp_path / "t"), "2026-02", "2026-03")
    assert sorted(r.n for r in got.collect()) == [i for i in range(40) if i % 4 in (1, 2)]
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString() and "PartitionFilters: []" not in got._jdf.queryExecution().toString()
