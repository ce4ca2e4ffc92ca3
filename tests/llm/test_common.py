from hushframe.llm import common


def test_scratch_keeps_what_it_is_told_to(spark):
    outer = common.materialize(spark.range(3), "outer")
    with common.scratch() as keep:
        inner = common.materialize(spark.range(4), "inner")
        kept = keep(common.materialize(inner, "kept"))
    assert kept.count() == 4 and outer.count() == 3
    for t, there in ((inner, False), (kept, True), (outer, True)):
        path = spark._jvm.org.apache.hadoop.fs.Path(t.hushframe_path)
        assert path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) == there


def test_settings_of_a_step_are_put_back(spark):
    before = spark.conf.get(common.BATCH_ROWS)
    common.materialize(spark.range(3), "step", 77)
    assert spark.conf.get(common.BATCH_ROWS) == before


def test_columns_of_stages_are_shielded(spark):
    @common.keeps_columns
    def stage(docs):
        return docs.withColumn("_x", docs["a"]).filter("_x > 1").select(*docs.columns)

    df = spark.createDataFrame([(1, 5), (2, 6)], "a int, _x int")
    assert [tuple(r) for r in stage(df).collect()] == [(2, 6)] and stage(df).columns == ["a", "_x"]
