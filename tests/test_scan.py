from umbra.sources.scan import spread


def test_spread_deals_small_scans_and_keeps_rows(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, "")], "id long, text string").coalesce(1).write.parquet(path)
    got = spread(spark.read.parquet(path))
    assert got.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted(map(repr, got.collect())) == sorted(map(repr, spark.read.parquet(path).collect()))
    assert spread(spark.read.parquet(path).where("false")).count() == 0


def test_spread_leaves_wide_scans(spark):
    wide = spark.range(0, 100, 1, 2 * spark.sparkContext.defaultParallelism)
    assert spread(wide) is wide
