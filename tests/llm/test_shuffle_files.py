"""Shuffle files of stored results are freed at once, and the results stay right."""

import time
from glob import glob

from pyspark.sql import functions as F

from verdigris.llm.common import FREES, cut, written


def grouped(spark):
    return spark.range(5000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))


def shuffle_files(spark) -> set:
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    return {f for d in folders for f in glob(f"{d}/*/shuffle*")}


def settled(spark, before: set, most: int) -> int:
    """New shuffle files, waited for until they are no more than `most`."""
    for _ in range(50):
        if (n := len(shuffle_files(spark) - before)) <= most:
            break
        time.sleep(0.1)
    return n


def test_stored_results_keep_no_shuffle_files(spark):
    was = spark.conf.get(FREES, "false")
    made = grouped(spark)
    before = shuffle_files(spark)
    stored = [cut(made), written(made, "grouped"), cut(made.join(made, "k").select("k"))]
    assert settled(spark, before, 0) == 0
    assert [d.count() for d in stored] == [7, 7, 7]
    assert made.count() == 7  # the same DataFrame can still be run
    assert spark.conf.get(FREES, "false") == was


def test_setting_comes_back_after_an_error(spark):
    was = spark.conf.get(FREES, "false")
    bad = spark.range(3).select(F.raise_error(F.lit("stop")).alias("x"))
    for store in (cut, lambda d: written(d, "bad")):
        try:
            store(bad)
            raise AssertionError("no error")
        except Exception as e:
            assert "stop" in str(e)
    assert spark.conf.get(FREES, "false") == was
