"""Audit chains, sessions and ordered folds."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from verdigris.functions.hashing import iso
from verdigris.operators.aggs import merkle_root, root_of
from verdigris.operators.ordered import Machine, scan

LINKED = ("actor", "action", "subject", "purpose", "value_hash")


def entry_hash(prev: Column, row: Callable[[str], Column]) -> Column:
    parts = [F.coalesce(prev, F.lit("")), *[F.coalesce(row(c).cast("string"), F.lit("")) for c in LINKED], iso(row("at"))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def append_chain(audit: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Link a batch of entries per shard in (at, id) order; `heads` (shard_id, head) continue earlier chains.

    A shard's entries are sorted in its partition and pass through in Arrow batches;
    only the last hash is held. What is hashed after it is put together by Spark.
    """
    rest = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in LINKED], iso(F.col("at")))
    row = F.struct("at", "id", *LINKED)
    d = audit.select("shard_id", row.alias("row"), rest.alias("rest"))
    d = d.join(heads.select("shard_id", "head"), "shard_id", "left") if heads is not None else d.withColumn("head", F.lit(None).cast("string"))
    d = d.repartition("shard_id").sortWithinPartitions("shard_id", "row.at", "row.id")
    schema = T.StructType([d.schema["shard_id"], d.schema["row"], T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = None, None
        for b in batches:
            prev, made = [], []
            for s, head, text in zip(b.column("shard_id").to_pylist(), b.column("head").to_pylist(), b.column("rest").to_pylist(), strict=True):
                if s != shard:
                    shard, last = s, head
                prev.append(last)
                last = hashlib.sha256(f"{last or ''}|{text}".encode()).hexdigest()
                made.append(last)
            yield pa.RecordBatch.from_arrays([b.column("shard_id"), b.column("row"), pa.array(prev, pa.string()), pa.array(made, pa.string())], names=schema.names)

    return d.mapInArrow(link, schema).select("shard_id", "row.*", "prev_hash", "hash")


def verify_chain(audit: DataFrame) -> DataFrame:
    """First bad entry of each shard: its link or its hash is wrong; null where the shard holds.

    Entries are sorted into ranges of (shard, at, id), each looked through alone; a
    table of each range's first and last entries by shard joins them, so a shard is as
    many tasks as it has entries for.
    """
    right = F.coalesce(F.col("hash") == entry_hash(F.col("prev_hash"), F.col), F.lit(False)).alias("right")
    d = audit.select("shard_id", "at", "id", "prev_hash", "hash", right)
    d = d.repartitionByRange("shard_id", "at", "id").sortWithinPartitions("shard_id", "at", "id")
    spot = T.StructType([d.schema["at"], d.schema["id"]])
    kind = to_arrow_schema(T.StructType([T.StructField("s", spot), d.schema["shard_id"]]))
    schema = T.StructType([d.schema["shard_id"], *[T.StructField(n, spot) for n in ("first", "first_wrong")], T.StructField("first_prev", T.StringType()), T.StructField("last_hash", T.StringType()), T.StructField("n", T.LongType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for b in batches:
            for shard, at, i, prev, made, ok in zip(*(b.column(c).to_pylist() for c in ("shard_id", "at", "id", "prev_hash", "hash", "right")), strict=True):
                if not out or out[-1]["shard_id"] != shard:
                    # The first entry's link is a matter of the range before.
                    out.append({"shard_id": shard, "first": {"at": at, "id": i}, "first_wrong": None, "first_prev": prev, "last_hash": prev, "n": 0})
                run = out[-1]
                if run["first_wrong"] is None and not (ok and prev == run["last_hash"]):
                    run["first_wrong"] = {"at": at, "id": i}
                run["last_hash"], run["n"] = made, run["n"] + 1
        if out:
            types = {"shard_id": kind.field(1).type, "first": kind.field(0).type, "first_wrong": kind.field(0).type, "first_prev": pa.string(), "last_hash": pa.string(), "n": pa.int64()}
            yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in out], t) for c, t in types.items()})

    runs = d.mapInArrow(look, schema)
    before = F.lag("last_hash").over(W.partitionBy("shard_id").orderBy("first"))  # one row a range
    met = runs.withColumn("_wrong", F.when(~F.col("first_prev").eqNullSafe(before), F.col("first")).otherwise(F.col("first_wrong")))
    return met.groupBy("shard_id").agg(F.min("_wrong")["id"].alias("first_bad"), F.sum("n").alias("n"))


def verify_against_root(spark: SparkSession, audit: DataFrame, root: str | None) -> DataFrame:
    """Structure, computed root, and whether it is the supplied one; ok if the structure holds and the anchor isn't false."""
    from verdigris.operators.aggs import shard_heads

    bad = verify_chain(audit).agg(F.count("first_bad").alias("_bad"))
    d = merkle_root(shard_heads(spark, audit)).join(F.broadcast(bad), F.lit(True))
    same = F.col("root") == F.lit(root)
    return d.select((F.col("_bad") == 0).alias("structure_ok"), "root", same.alias("anchor_ok"), ((F.col("_bad") == 0) & F.coalesce(same, F.lit(True))).alias("ok"))


def roll_roots(audit: DataFrame, interval: str = "1 hour", shards: int = 8) -> DataFrame:
    """Shard heads and root at the end of each interval that has entries."""
    d = audit.withColumn("rolled_at", F.window("at", interval)["end"])
    last = d.groupBy("rolled_at", "shard_id").agg(F.max_by("hash", F.struct("at", "id")).alias("hash"))
    spine = last.select("rolled_at").distinct().withColumn("shard_id", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    w = W.partitionBy("shard_id").orderBy("rolled_at").rowsBetween(W.unboundedPreceding, 0)
    heads = spine.join(last, ["rolled_at", "shard_id"], "left").withColumn("head", F.last("hash", ignorenulls=True).over(w))
    leaf = F.sha2(F.concat(F.col("shard_id").cast("string"), F.lit(":"), F.coalesce("head", F.lit(""))), 256)
    g = heads.groupBy("rolled_at").agg(F.array_sort(F.collect_list(F.struct("shard_id", "head", leaf.alias("leaf")))).alias("heads"))
    return g.select("rolled_at", root_of(F.transform("heads", lambda h: h["leaf"])).alias("root"), F.transform("heads", lambda h: F.struct(h["shard_id"].alias("shard_id"), h["head"].alias("head"))).alias("heads"))


def tamper_window(rolls: DataFrame, audit: DataFrame) -> DataFrame:
    """Per shard: the first roll whose head no longer exists and the last agreeing roll before it."""
    h = rolls.select("rolled_at", F.explode("heads").alias("h")).select("rolled_at", "h.shard_id", "h.head").filter("head IS NOT NULL")
    d = h.join(audit.select(F.col("hash").alias("head"), F.lit(True).alias("_ok")).distinct(), "head", "left")
    first = d.groupBy("shard_id").agg(F.min(F.when(F.col("_ok").isNull(), F.col("rolled_at"))).alias("first_missing"))
    return d.join(first, "shard_id").groupBy("shard_id", "first_missing").agg(F.max(F.when(F.col("_ok") & (F.col("rolled_at") < F.col("first_missing")), F.col("rolled_at"))).alias("last_agreeing")).filter("first_missing IS NOT NULL")


def review_sessions(activity: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Session number and full hours since its start; idle time over the gap (not equal) starts a new one."""
    w = W.partitionBy("actor").orderBy("at", "id")
    new = F.col("at") - F.lag("at").over(w) > F.expr(f"interval {gap}")
    d = activity.withColumn("session", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w))
    start = F.min("at").over(W.partitionBy("actor", "session"))
    seconds = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return d.withColumn("hour_into_session", F.floor(seconds / 3_600_000_000))


def novelty_alerts(fields: DataFrame, hours: int = 6) -> DataFrame:
    """fields (key, at, id): alerts with their opening; a field joins the newest one opened at most `hours` before.

    A key's rows pass sorted through one task, which holds the opening alone.
    """
    span = hours * 3_600_000_000

    def step(opened: int | None, event: tuple) -> tuple[int, None]:
        return (opened if opened is not None and event[0] <= opened + span else event[0]), None

    rows = fields.select("key", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "id")
    d = scan(rows, "key", ["us", "id"], ["us"], Machine(None, step), "long")
    return d.groupBy("key", F.timestamp_micros("state").alias("opened")).agg(F.count(F.lit(1)).alias("n"))


def supersede_configs(versions: DataFrame) -> DataFrame:
    """Each version of (scope, key) gets the id that follows; an author may not approve their own."""
    bad = F.col("author") == F.col("approver")
    w = W.partitionBy("scope", "key", "_bad").orderBy("effective_from", "id")
    d = versions.withColumn("_bad", bad).withColumn("superseded_by", F.when(~F.col("_bad"), F.lead("id").over(w)))
    return d.withColumn("reason_code", F.when(F.col("_bad"), "author_is_approver")).drop("_bad")


def next_versions(publishes: DataFrame, existing: DataFrame, carried: list[str]) -> DataFrame:
    """Version = previous + 1 per record group; columns that aren't given are carried forward."""
    w = W.partitionBy("record_group").orderBy("at", "id")
    d = publishes.join(existing.groupBy("record_group").agg(F.max("version").alias("_have")), "record_group", "left")
    d = d.withColumn("version", F.row_number().over(w) + F.coalesce("_have", F.lit(0))).drop("_have")
    for c in carried:
        d = d.withColumn(c, F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d


def cluster_cuts(coords: DataFrame, tol: float = 8.0) -> DataFrame:
    """coords (key, c, lo, hi): sorted distinct coordinates at least `tol` apart; fewer than two fall back to the box."""

    def step(acc: Column, c: Column) -> Column:
        near = F.coalesce(c - F.try_element_at(acc, F.lit(-1)) < tol, F.lit(False))
        return F.when(near, acc).otherwise(F.concat(acc, F.array(c)))

    g = coords.groupBy("key").agg(F.array_sort(F.collect_set("c")).alias("cs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    kept = F.aggregate("cs", F.array().cast("array<double>"), step)
    return g.select("key", kept.alias("cuts"), "lo", "hi").select("key", F.when(F.size("cuts") < 2, F.array("lo", "hi")).otherwise(F.col("cuts")).alias("cuts"))


#: States of a scope that starts cold.
COLD_STATES = ("shadow", "ramp", "steady", "regression")


def cold_start_step(least: int) -> Callable[[str, tuple], tuple[str, None]]:
    """Evidence (n, calibrated, target_met, alert, recovered) that is null counts as none."""

    def step(state: str, event: tuple) -> tuple[str, None]:
        n, calibrated, target_met, alert, recovered = event
        enough = n is not None and n >= least
        if state == "shadow":
            return ("ramp" if enough else state), None
        if state == "ramp":
            return ("regression" if alert else "steady" if enough and calibrated and target_met else state), None
        if state == "steady":
            return ("regression" if alert else state), None
        return ("ramp" if recovered and enough and not alert else state), None

    return step


def cold_start_states(evidence: DataFrame, least: int = 3) -> DataFrame:
    """State of each scope after its ordered evidence (ord, n, calibrated, target_met, alert, recovered)."""
    cols = ["n", "calibrated", "target_met", "alert", "recovered"]
    d = scan(evidence, "scope", ["ord"], cols, Machine("shadow", cold_start_step(least), lambda event: COLD_STATES))
    last = d.groupBy("scope").agg(F.max_by("state", "ord").alias("state"))
    return last.withColumn("auto_accept_allowed", F.col("state") == "steady").withColumn("elevated_sampling", F.col("state").isin("ramp", "regression"))


def next_band(parcels: DataFrame) -> DataFrame:
    """y centre (0 without a box) and the next parcel's, infinity for the last; of equal centres a missing id is last."""
    d = parcels.withColumn("center", F.coalesce(F.col("y") + F.col("h") / 2, F.lit(0.0)))
    return d.withColumn("next_center", F.lead("center", 1, float("inf")).over(W.partitionBy("page_id").orderBy("center", F.asc_nulls_last("id"))))
