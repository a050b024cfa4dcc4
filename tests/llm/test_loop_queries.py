"""The small queries of a loop are one job each, so that the driver keeps no plan and no thread for each of their shuffles."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.llm.common import cut, nothing_in


def jobs_of(spark, group, act):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = act()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_loop_s_queries_are_planned_once(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    d = spark.range(1000).withColumn("k", F.col("id") % 10)
    counts = d.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    table, jobs = jobs_of(spark, "loop-cut", lambda: cut(counts.groupBy("n").agg(F.sum("k").alias("s")), narrow=True))
    assert jobs == 1
    assert [tuple(r) for r in table.collect()] == [(100, 45)]
    assert nothing_in(counts.filter("n > 100")) and not nothing_in(counts)
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
