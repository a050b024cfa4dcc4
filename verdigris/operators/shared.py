"""The folder that driver and executors share, and lineage cut in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or the checkpoint folder that is set.

    Where neither is set, a machine-local folder will do only if driver and
    executors are one process (local tests); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a Parquet table into the shared folder and read it again, for rows that are dear to make and read by many steps."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that one task holds at a time.
DEALT = 500_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by their keys, a task for each DEALT rows at least, so that a task's memory doesn't grow with the table.

    Aggregations and joins by these keys, and aggregations by these and more, need no
    further shuffle.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-df.count() // DEALT)), *keys)
