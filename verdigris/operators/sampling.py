"""Order, limits, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.operators.joins import BLOCKING
from verdigris.operators.shared import cut


def ranks(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Global row numbers from 1 without one task for all: sorted partitions and their offsets."""
    p = df.sort(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    p = cut(p)
    first = p.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offset = first.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy("_at"))
    return p.withColumn("_in", inside).join(F.broadcast(offset), "_part").withColumn(out, F.col("_in") + F.col("_off")).drop("_part", "_at", "_in", "_off")


def claim_next(tasks: DataFrame, actors: DataFrame) -> DataFrame:
    """Oldest free tasks to actors in the order they asked; no task twice."""
    free = ranks(tasks.filter("assignee IS NULL AND closed_at IS NULL").select("id", "opened_at"), ["opened_at", "id"], "n")
    asked = ranks(actors, ["asked_at", "actor"], "n")
    return free.join(asked, "n").select("id", "actor")


def open_rows(df: DataFrame) -> DataFrame:
    """Oldest first."""
    return df.orderBy("opened_at", "id")


def aged(conflicts: DataFrame, now: Column, age: str) -> DataFrame:
    """Conflicts in a blocking state opened before now - age, oldest first."""
    return conflicts.filter(F.col("state").isin(*BLOCKING) & (F.col("opened_at") < now - F.expr(f"interval {age}"))).orderBy("opened_at", "id")


def drain(outbox: DataFrame, n: int = 100) -> DataFrame:
    """The oldest n rows not yet dispatched, marked as such."""
    return outbox.filter("NOT dispatched").orderBy("created_at", "id").limit(n).withColumn("dispatched", F.lit(True)).withColumn("attempts", F.col("attempts") + 1)


def top_k(candidates: DataFrame, by: str, k: int) -> DataFrame:
    """The k best (confidence, value) of each key; the rank's limit is applied before the shuffle, too."""
    w = W.partitionBy(by).orderBy(F.desc("confidence"), F.desc("value"))
    d = candidates.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return d.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value", "confidence"))), lambda x: F.struct(x["value"].alias("value"), x["confidence"].alias("confidence"))).alias("top_k"))


def fraction(key: Column) -> Column:
    """A stable number in [0, 1) from a text's digest."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def audit_sample(fields: DataFrame, rate: float = 0.05, elevated: float = 0.20) -> DataFrame:
    """Stable sample of accepted fields; a higher rate in elevated posture."""
    return fields.withColumn("sampled", fraction(F.col("id")) < F.when(F.col("elevated"), elevated).otherwise(rate))


def split_train_eval(labels: DataFrame, part: float = 0.2) -> DataFrame:
    """By digest: the last max(1, int(n * part)) digests in order go to eval; one digest or none: all train."""
    d = ranks(labels.select("digest").distinct(), ["digest"], "_n")
    total = labels.agg(F.count_distinct("digest")).first()[0]
    last = max(1, int(total * part)) if total > 1 else 0
    return labels.join(d, "digest").withColumn("part", F.when(F.col("_n") > total - last, "eval").otherwise("train")).drop("_n")
