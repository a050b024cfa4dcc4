"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space (\x20 and \x09-\x0D) as a Java regex class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only where none is set and driver and executors are one process (local tests)
    a folder of our own is set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files when they have ended, not when the driver next collects garbage.

    For queries whose result is stored: nothing reads those files again. While a
    query runs its files stay, so a lost executor costs it no more than otherwise.
    """
    before = spark.conf.get(FREES, "false")
    spark.conf.set(FREES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREES, before)


ADAPTS = "spark.sql.adaptive.enabled"


@contextmanager
def planned_once(spark: SparkSession) -> Iterator[None]:
    """Queries run inside are planned once, as one job each, and free their shuffle files.

    Adaptive execution plans a query anew after each of its shuffles, each of which is a job
    with a thread of its own and a plan that the driver keeps. For the many small queries
    of a loop those add up in the driver's memory.
    """
    before = spark.conf.get(ADAPTS)
    spark.conf.set(ADAPTS, "false")
    try:
        with freeing(spark):
            yield
    finally:
        spark.conf.set(ADAPTS, before)


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder; survives lost executors.

    narrow: for tables of a few numbers a row that a loop makes anew in every round. They
    go into two files a core at most, since a file takes a block of disk however few rows
    it has, and so does each task of the next round for its shuffle; see `planned_once`.
    """
    spark = df.sparkSession
    shared_dir(spark)
    with planned_once(spark) if narrow else freeing(spark):
        # A query of its own, since a DataFrame keeps the setting that it was made under.
        own = df.coalesce(2 * spark.sparkContext.defaultParallelism) if narrow else df.select("*")
        return own.checkpoint(eager=True)


def nothing_in(df: DataFrame) -> bool:
    """Whether a DataFrame has no rows; its shuffle files go at once. For small queries of a loop, see `planned_once`."""
    with planned_once(df.sparkSession):
        return df.select("*").isEmpty()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a Parquet table into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with freeing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The runs of characters outside ASCII white space, as an array (null text: empty)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of such runs, without building them for the caller."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    edge = (F.element_at(parts, 1) == "").cast("long")
    edge += F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.size(parts).cast("long") - edge


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once a row, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
