"""Groups in Python: every task gets some of them, and a group that batches cut is put together."""

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from latticeworks.session import by_group


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_groups_as_apply_in_pandas_has_them(spark, batch):
    rows = spark.range(400).select(F.expr("case when id % 9 < 7 then concat('k', id % 9) end").alias("k"), F.expr("cast(nullif(id % 2, 1) as int)").alias("j"), F.expr("id * 37 % 401").alias("v"))

    def solve(pdf):
        return pdf.assign(n=len(pdf), at=range(len(pdf)))[["k", "j", "v", "n", "at"]]

    schema = "k string, j double, v long, n long, at long"
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = rows.withColumn("j", F.col("j").cast("double"))
        got = sorted(map(repr, by_group(rows, ["k", "j"], solve, schema, (F.desc("v"),)).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = rows.groupBy("k", "j").applyInPandas(lambda pdf: solve(pdf.sort_values("v", ascending=False)), schema).collect()
    assert got == sorted(map(repr, want))


def test_small_groups_run_in_several_tasks(spark):
    def solve(pdf):
        return pdf.assign(task=TaskContext.get().partitionId())

    got = by_group(spark.range(64).select(F.col("id").alias("k")), ["k"], solve, "k long, task int").collect()
    assert len(got) == 64 and len({r["task"] for r in got}) == 4
