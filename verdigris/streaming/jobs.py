"""Structured Streaming forms of the jobs; replays and restarts give no second effect.

Sinks are keyed by batch id: a batch that runs again overwrites its own folder.
Stateful operators keep rows that the watermark hasn't passed and one small row a key,
and forget both when they can't matter any more (`keyed`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.projections import OUTCOMES
from verdigris.sources.files import reject_reason
from verdigris.streaming import keyed


def drained(stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None, ends: bool = False) -> DataFrame:
    """Run a stream over what is there now and return all that it wrote below `path`.

    ends: no more rows will come (a replay of stored tables). The stream, built with
    `ending` on the same path, is then started once more with a mark of the last time,
    which moves the watermark past all rows.
    """
    spark = stream.sparkSession
    schema: list = []

    def write(batch: DataFrame, number: int) -> None:
        out = each(batch, number) if each else batch
        schema[:] = [out.schema]
        out.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    def run() -> None:
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, keyed.STORE)
    try:
        run()
        if ends:
            spark.range(1).select(F.lit(LAST).cast("timestamp").alias("at")).write.mode("append").parquet(f"{path}/ends")
            run()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.parquet(f"{path}/data/*")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: The time of end marks, the latest full century that pandas can hold.
LAST = "2200-01-01 00:00:00"


def ending(stream: DataFrame, at: str, path: str) -> DataFrame:
    """The stream with the marks of its end that `drained` writes below `path`; `ends` tells them from rows."""
    spark = stream.sparkSession
    spark.createDataFrame([], "at timestamp").write.mode("append").parquet(f"{path}/ends")
    marks = spark.readStream.schema("at timestamp").parquet(f"{path}/ends").select(F.col("at").alias(at), F.lit(True).alias("ends"))
    return stream.withColumn("ends", F.lit(False)).unionByName(marks, allowMissingColumns=True)


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """A table's file or folder as a stream of its files.

    The path goes in as a glob, since the file source takes a plain path for a folder.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{path[:-1]}[{path[-1]}]")


def batch_files(spark: SparkSession, drop: str, out: str) -> None:
    """Files of a watched folder, each handled once: accepted and quarantined rows by batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", "*.meta.json").load(drop)
    meta = F.from_json(F.decode("content", "UTF-8"), "district string, mime string")
    rows = files.select(F.regexp_replace("path", r"\.meta\.json$", "").alias("path"), meta.alias("m")).select("path", "m.*")
    rows = rows.withColumn("reason_code", reject_reason(F.col("district"), F.col("mime")))

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # two tables, but each file is opened once
        batch.filter("reason_code IS NULL").write.mode("overwrite").parquet(f"{out}/accepted/batch={number}")
        batch.filter("reason_code IS NOT NULL").write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        batch.unpersist()

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def decide(fields: DataFrame, late: str = "1 day") -> DataFrame:
    """fields (id, outcome, ord, at, ends): each id is decided once, by the first known outcome that comes; see `keyed.Deciding`."""
    rows = keyed.rows(fields, {"id": F.col("id")}, "at", F.coalesce("ord", F.lit(0)), [F.col("outcome")])
    return keyed.run(rows, ["id"], keyed.Deciding(tuple(OUTCOMES)), "id string, outcome string, status string", late)


def sessions(activity: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """activity (actor, at, ends): each review session once, when the watermark has passed its end.

    Idle time of more than `gap` ends a session; at just `gap` it goes on, as Spark's
    session windows have it. The end mark is a session of its own and goes.
    """
    g = activity.withWatermark("at", late).groupBy("actor", F.session_window("at", gap).alias("w"))
    d = g.agg(F.count(F.lit(1)).alias("n"), F.bool_or("ends").alias("ends"))
    return d.filter("NOT ends").select("actor", F.col("w.start").alias("started_at"), "n")


HOUR = 3_600_000_000


def alert_fold(span: int) -> Callable:
    """An alert takes what comes within `span` of its opening; the counts by opening are what these rows add."""

    def fold(state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        opened = state[0] if state else None
        counts: dict[int, int] = {}
        for t, _, _ in rows:
            if opened is None or t > opened + span:
                opened = t
            counts[opened] = counts.get(opened, 0) + 1
        return (opened,), list(counts.items())

    return fold


def alerts(fields: DataFrame, hours: int = 6, late: str = "1 day") -> DataFrame:
    """fields (key, at, ends): anchored alerts (key, opened_us, n) with the fields that each step of the watermark adds.

    An alert is forgotten once the watermark is past its span.
    """
    span = hours * HOUR
    rows = keyed.rows(fields, {"key": F.col("key").cast("long")}, "at", F.lit(0), [])
    processor = keyed.Ordered(["key", "opened_us", "n"], alert_fold(span), lambda state: state[0] + span)
    return keyed.run(rows, ["key"], processor, "key long, opened_us long, n long", late)


def page_terminal(fields: DataFrame, expected: DataFrame, late: str = "1 day", keep: str = "30 days") -> DataFrame:
    """A page once, when its last field is decided; fields (page_id, field, routing_outcome, at, ends), expected (page_id, fields) is static.

    A field that is delivered again counts once. A page's state leaves `keep` after its
    last row, complete or not.
    """
    ok = F.coalesce(F.col("routing_outcome").isin(*OUTCOMES), F.lit(False))
    found = fields.join(expected, "page_id", "left").filter("ends OR fields IS NOT NULL")
    rows = keyed.rows(found, {"page_id": F.col("page_id")}, "at", F.lit(0), [F.col("field").cast("string").alias("field"), "fields", ok.alias("ok")])
    days = int(keep.split()[0])
    return keyed.run(rows, ["page_id"], keyed.Terminal(days * 24 * HOUR), "page_id long", late)


def activity(audit: DataFrame, actions: dict[str, str]) -> DataFrame:
    """Day-tumbling counts of the dashboard's actions, in update mode: rows of any age count, the state is one row a district and day."""
    d = audit.filter(F.col("action").isin(*actions.values()))
    g = d.groupBy(F.coalesce("district", F.lit("")).alias("district"), F.window("at", "1 day").alias("w")).agg(*[F.count_if(F.col("action") == a).alias(n) for n, a in actions.items()])
    return g.select("district", F.to_date("w.start").alias("day"), *actions)


def config_fold(state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
    """Versions replace each other, requests get the one in force."""
    value = state[0] if state else None
    out = []
    for _, _, r in rows:
        if "request" in r:
            out.append((r["request"], value, None if value is not None else "no_effective_version"))
        else:
            value = r["value"]
    return (value,), out


def config_join(requests: DataFrame, versions: DataFrame, late: str = "1 day") -> DataFrame:
    """requests (request_id, scope, key, at, ends) and versions (scope, key, effective_from, value), both streams: the version in force at each request.

    Both meet in the state of their (scope, key), which holds one version besides what
    waits for the watermark; a version is read once. It is kept for ever, since any
    later request may ask for it. At equal times versions come first.
    """
    keys = {"scope": F.col("scope"), "key": F.col("key")}
    asked = keyed.rows(requests, keys, "at", F.lit(1), [F.col("request_id").alias("request")])
    given = versions.withColumn("ends", F.lit(False)).withColumn("at", F.col("effective_from").cast("timestamp"))
    given = keyed.rows(given, keys, "at", F.lit(0), ["value"])
    processor = keyed.Ordered(["scope", "key", "request_id", "value", "reason_code"], config_fold, lambda state: None)
    return keyed.run(asked.unionByName(given), ["scope", "key"], processor, "scope string, key string, request_id long, value double, reason_code string", late)


NEXT = {"shadow", "ramp", "steady", "regression"}


def next_state(state: str, n: int, calibrated: bool, target_met: bool, alert: bool, recovered: bool, least: int = 3) -> str:
    """One step of the cold-start machine."""
    if state == "shadow":
        return "ramp" if n >= least else state
    if state == "ramp":
        return "regression" if alert else "steady" if n >= least and calibrated and target_met else state
    if state == "steady":
        return "regression" if alert else state
    return "ramp" if recovered and n >= least and not alert else state


def cold_start_fold(state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
    now = state[0] if state else "shadow"
    for _, _, r in rows:
        now = next_state(now, r["n"], r["calibrated"], r["target_met"], r["alert"], r["recovered"])
    return (now,), [(rows[-1][1], now)]


def cold_start(evidence: DataFrame, late: str = "1 day") -> DataFrame:
    """evidence (scope, at, ord, n, ..., ends): state of each scope with the last piece of evidence that it counts, at each step of the watermark.

    Evidence counts in order of (at, ord). A scope's state is one word and stays.
    """
    body = ["n", "calibrated", "target_met", "alert", "recovered"]
    rows = keyed.rows(evidence, {"scope": F.col("scope")}, "at", F.coalesce("ord", F.lit(0)), body)
    processor = keyed.Ordered(["scope", "ord", "state"], cold_start_fold, lambda state: None)
    return keyed.run(rows, ["scope"], processor, "scope long, ord long, state string", late)
