"""Queries of the streaming jobs: each runs over the table's files as a stream until all is read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from verdigris.operators.aggs import ACTIONS
from verdigris.operators.shared import cut, shared_dir
from verdigris.plans.folds import ALERTS
from verdigris.plans.registry import ORACLE, query
from verdigris.plans.views import VIEWS, table
from verdigris.sources.files import put_files
from verdigris.streaming import jobs as J


def place(spark, name: str) -> str:
    """A fresh folder below the cluster's shared one."""
    return f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


def events(spark, sf):
    return J.rows_of(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


DROPPED = "case when s_nationkey % 10 = 9 then '  ' else n_name end as district, case s_suppkey % 5 when 0 then 'application/pdf' when 1 then 'image/tiff' when 2 then 'image/png' when 3 then 'image/jpeg' else 'text/plain' end as mime"


@query("SRC2_stream_batch_files", f"""
select s_suppkey, case when trim(district) = '' then 'missing_mandatory_field:district' when mime = 'text/plain' then 'unsupported_mime_type' end as reason_code
from (select s_suppkey, {DROPPED} from supplier join nation on s_nationkey = n_nationkey)""")
def src2(spark, sf):
    """One sidecar file per supplier is put into a drop folder; the stream takes each once, also when it is started again."""
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_suppkey", *DROPPED.split(", ", 1))
    folder = place(spark, "drop")
    put_files(rows.select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".scan.meta.json")).alias("name"), F.to_json(F.struct("district", "mime")).alias("content")), f"{folder}/in")
    for _ in range(2):
        J.batch_files(spark, f"{folder}/in", f"{folder}/out")
    both = spark.read.parquet(f"{folder}/out/accepted").unionByName(spark.read.parquet(f"{folder}/out/rejected"))
    return both.select(F.regexp_extract("path", r"([0-9]+)\.scan$", 1).cast("long").alias("s_suppkey"), "reason_code")


FIELD = "cast(event_id as string) as id, case event_id % 6 when 0 then 'review' when 1 then 'auto_accept' when 2 then 'conflict' when 3 then 'audit_sample' when 4 then 'bogus' else 'outside_calibrated_regime' end as outcome"


def span(df, at: str) -> str:
    """How far apart a stored table's rows are: that late any of them may be read."""
    r = df.agg(F.ceil(F.coalesce((F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1_000_000, F.lit(0))).alias("s")).first()
    return f"{r['s'] + 1} seconds"


def late_events(spark, sf):
    """The event stream with its end marks, the folder it runs in, and how late its rows may be."""
    path = place(spark, "events")
    stored = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return J.ending(events(spark, sf), "ts", path), path, span(stored, "ts")


@query("STR1_stream_decide", f"with e as (select {FIELD.replace('string', 'varchar')} from events) select id, outcome, case when outcome = 'bogus' then 'error' else 'decided' end as status from e")
def str1(spark, sf):
    e, path, late = late_events(spark, sf)
    return J.drained(J.decide(e.selectExpr(*FIELD.split(", ", 1), "event_id as ord", "ts as at", "ends"), late), path, ends=True).select("id", "outcome", "status")


@query("STR2_stream_sessions", """
with g as (select 'u' || user_id as actor, ts, ts - lag(ts) over (partition by user_id order by ts) > interval 1 hour as fresh from events),
s as (select actor, ts, sum(coalesce(fresh, true)::int) over (partition by actor order by ts, fresh rows unbounded preceding) as session from g)
select actor, min(ts)::timestamp as started_at, count(*) as n from s group by actor, session""")
def str2(spark, sf):
    e, path, late = late_events(spark, sf)
    a = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.col("ts").alias("at"), "ends")
    d = J.drained(J.sessions(a, late=late), path, ends=True)
    return d.select("actor", F.col("started_at").cast("timestamp_ntz").alias("started_at"), "n")


@query("STR3_stream_alerts", ALERTS)
def str3(spark, sf):
    e, path, late = late_events(spark, sf)
    e = e.filter("ends OR event_type in ('error', 'click')").selectExpr("user_id as key", "ts as at", "ends")
    d = J.drained(J.alerts(e, late=late), path, ends=True).groupBy("key", "opened_us").agg(F.sum("n").alias("n"))
    return d.select("key", F.timestamp_micros("opened_us").cast("timestamp_ntz").alias("opened"), "n")


@query("STR4_stream_page_terminal", None)
def str4(spark, sf):
    path = place(spark, "terminal")
    expr = VIEWS["v_extraction"].split("case l_partkey % 7")[1].split(" as routing_outcome")[0]
    key = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as date))"
    lines = J.ending(J.rows_of(spark, f"{sf}/lineitem.parquet").withColumn("at", F.col("l_shipdate").cast("timestamp")), "at", path)
    f = lines.selectExpr("l_orderkey as page_id", f"{key} as field", f"case l_partkey % 7{expr} as routing_outcome", "at", "ends").filter("ends OR page_id % 3 <> 0")
    stored = table(spark, sf, "lineitem").select("l_orderkey", F.expr(key).alias("field"), F.col("l_shipdate").cast("timestamp").alias("at"))
    want = stored.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.count_distinct("field").alias("fields"))
    return J.drained(J.page_terminal(f, cut(want), span(stored, "at")), path, ends=True).select("page_id")


@query("STR5_stream_activity")
def str5(spark, sf):
    e = events(spark, sf)
    a = e.select(F.expr("case event_type when 'view' then 'page.ingested' when 'click' then 'page.processed' when 'purchase' then 'record.published' else 'other' end").alias("action"), F.col("ts").alias("at"), F.concat(F.lit("district"), (F.col("user_id") % 7).cast("string")).alias("district"))
    d = J.drained(J.activity(a, ACTIONS), place(spark, "activity"), "update")
    return d.groupBy("district", "day").agg(F.max_by(F.struct(*ACTIONS), "_batch").alias("r")).select("district", "day", "r.*")


@query("STR7_stream_config_join")
def str7(spark, sf):
    e, path, late = late_events(spark, sf)
    scope, key = "if(user_id % 2 = 0, 'district', 'global') as scope", "concat('k', user_id % 11) as key"
    r = e.filter("ends OR event_type = 'view'").selectExpr("event_id as request_id", scope, key, "ts as at", "ends")
    v = events(spark, sf).filter("event_type = 'purchase'").selectExpr(scope, key, "ts as effective_from", "cast(value as double) as value")
    return J.drained(J.config_join(r, v, late), path, ends=True).select("request_id", "scope", "key", "value", "reason_code")


@query("STR9_stream_cold_start")
def str9(spark, sf):
    e, path, late = late_events(spark, sf)
    e = e.selectExpr("user_id as scope", "event_id as ord", "ts as at", "ends", "cast(event_id % 7 as int) as n", "event_id % 5 <> 0 as calibrated", "event_id % 3 <> 0 as target_met", "event_id % 11 = 0 as alert", "event_id % 2 = 0 as recovered")
    d = J.drained(J.cold_start(e, late), path, ends=True).groupBy("scope").agg(F.max_by("state", "_batch").alias("state"))
    return d.withColumn("auto_accept_allowed", F.col("state") == "steady").withColumn("elevated_sampling", F.col("state").isin("ramp", "regression"))


# What a stream must equal is what the batch query must equal.
for stream, batch in (("STR4_stream_page_terminal", "AGG3_page_terminal"), ("STR5_stream_activity", "AGG1_page_activity"), ("STR7_stream_config_join", "JOI5_effective_config"), ("STR9_stream_cold_start", "WIN12_cold_start_states")):
    ORACLE[stream] = ORACLE[batch]
