from latticeworks.llm import scratch


def test_tables_are_cut_off_and_cleared(spark):
    df = scratch.materialize(spark.range(10).withColumnRenamed("id", "x"), "numbers")
    assert df.count() == 10 and len(df.inputFiles()) > 0
    empty = scratch.materialize(spark.range(0), "none")
    assert empty.count() == 0 and empty.columns == ["id"]
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    import os

    assert os.path.isdir(folder)
    scratch.drop(df)
    scratch.clear(spark)
    assert not os.path.isdir(folder)
