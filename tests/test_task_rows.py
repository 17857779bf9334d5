"""What one task holds does not grow with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from towerlens import session
from towerlens.operators import slices


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    frame = spark.range(20_000).select((F.col("id") % 997).alias("k"), F.col("id").alias("at"))
    summed = slices.running(slices.slice_groups(frame, ("k",), ("at",)), {"n": F.lit(1)})
    rows = summed.rows().withColumn("_task", F.spark_partition_id())
    sizes = [r["count"] for r in rows.groupBy("_task").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) >= 30 and max(sizes) < 2_000
    assert summed.rows().groupBy("k").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == 20_000
    assert summed.rows()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_groups_above_the_limit_beside_others(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    frame = spark.range(1_000).select(F.when(F.col("id") < 600, 1).when(F.col("id") < 990, F.col("id") % 9 + 2).alias("k"), F.col("id").alias("at"))
    sliced = slices.slice_groups(frame, ("k",), ("at",), 200)
    got = {(r.k, r.at): r.n for r in slices.running(sliced, {"n": F.lit(1)}).rows().collect()}
    seen = {}
    for k, at in sorted(((r.k, r.at) for r in frame.collect()), key=lambda x: x[1]):
        seen[k] = seen.get(k, 0) + 1
        assert got[k, at] == seen[k]
    assert len(got) == 1_000 and sliced.split
