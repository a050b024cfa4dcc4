"""Queries of the workflow jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import aggs as A
from verdigris.operators import reprocess as R
from verdigris.operators import workflow as O
from verdigris.operators.shared import dealt
from verdigris.plans.joins import BANDS, STRIKES, TOK, polygons, strokes
from verdigris.plans.registry import query
from verdigris.plans.views import table, view

KNOWN = "routing_outcome in ('audit_sample', 'auto_accept', 'conflict', 'outside_calibrated_regime', 'review')"
DECIDE = f"""
s as (select id, routing_outcome as outcome, case when index_position % 3 = 0 then 'review' end as had, coalesce({KNOWN}, false) as known from v_extraction),
d as (select id, outcome, case when not known then 'error' when had is null then 'decided' when had = outcome then 'replayed' else 'refused' end as status from s)
"""


def decisions(spark, sf):
    e = view(spark, sf, "v_extraction").select("id", F.col("routing_outcome").alias("outcome"), F.lit(1).alias("ord"), "index_position")
    had = e.filter("index_position % 3 = 0").select("id", F.lit("review").alias("outcome"))
    again = e.withColumn("ord", F.lit(2)).withColumn("outcome", F.lit("review"))
    return O.decide(e.unionByName(again).filter("ord = 1 OR outcome IS NOT NULL"), had)


@query("JOB1_decide", f"with {DECIDE} select id, outcome, status, case status when 'error' then 'unknown_outcome' when 'refused' then 'already_decided_otherwise' end as reason_code from d")
def job1(spark, sf):
    return decisions(spark, sf)


@query("JOB1_fan_out", f"""
with {DECIDE} select id, case outcome when 'review' then 'review_task:routed' when 'audit_sample' then 'review_task:audit' when 'conflict' then 'conflict' else 'alert' end as opens from d where status = 'decided' and outcome <> 'auto_accept'
union all select id, 'audit_sample' from d where status = 'decided' and outcome = 'audit_sample'""")
def job1b(spark, sf):
    return O.fan_out(decisions(spark, sf))


SUBMIT = "select page_id, part_id, created_at, field_class, actor, levenshtein(predicted, corrected)::int as edit_distance, case when field_class in ('area', 'owner_name', 'share_fraction', 'survey_number') and levenshtein(predicted, corrected) > 4 then 'pending' else 'correction' end as target from v_correction"


@query("JOB2_submit_corrections", SUBMIT)
def job2(spark, sf):
    return O.submit_corrections(view(spark, sf, "v_correction")).drop("predicted", "corrected")


@query("JOB3_confirm_corrections", """
with p as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey as id, min('u' || (l_suppkey % 6)) as maker, min('u' || (l_partkey % 4)) as claimant, bool_or(l_suppkey % 9 = 0) as resolved, max('u' || (l_orderkey % 6)) as actor, bool_or(l_suppkey % 13 = 0) as gone from lineitem group by 1)
select id, actor, case when gone then 'pending_not_found' when resolved then 'already_resolved' when actor = maker then 'same_as_maker' when actor = claimant then 'same_as_claimant' end as reason_code, not (gone or resolved or actor = maker or actor = claimant) as confirmed from p""")
def job3(spark, sf):
    p = table(spark, sf, "lineitem").selectExpr("concat_ws('-', l_orderkey, l_linenumber, l_partkey) as id", "concat('u', l_suppkey % 6) as maker", "concat('u', l_partkey % 4) as claimant", "l_suppkey % 9 = 0 as resolved", "concat('u', l_orderkey % 6) as actor", "l_suppkey % 13 = 0 as gone")
    p = p.groupBy("id").agg(F.min("maker").alias("maker"), F.min("claimant").alias("claimant"), F.bool_or("resolved").alias("resolved"), F.max("actor").alias("actor"), F.bool_or("gone").alias("gone"))
    return O.confirm_corrections(p.select("id", "actor"), p.filter("NOT gone").drop("gone", "actor"))


EVENTS = "select user_id as id, event_id as ord, case event_id % 5 when 0 then 'resolved' when 1 then 'under_enquiry' when 2 then 'referred' when 3 then 'open' else 'lost' end as \"to\", case when event_id % 3 = 0 then 'done' end as resolution from events"


@query("JOB4_conflict_transitions", f"""
with recursive e as (select *, row_number() over (partition by id order by ord) as rn from ({EVENTS})), t as (
select id, 0::bigint as rn, 0::bigint as ord, 'open' as state, null::varchar as reason_code from (select distinct id from e) union all
select e.id, e.rn, e.ord, case when e."to" = 'lost' or e."to" = t.state or (e."to" = 'resolved' and resolution is null) then t.state else e."to" end,
 case when e."to" = 'lost' then 'unknown_state' when e."to" = t.state then 'same_state' when e."to" = 'resolved' and resolution is null then 'resolution_required' end from t join e on e.id = t.id and e.rn = t.rn + 1)
select id, ord, state, reason_code from t where rn > 0""")
def job4(spark, sf):
    e = table(spark, sf, "events").selectExpr("user_id as id", "event_id as ord", "elt(event_id % 5 + 1, 'resolved', 'under_enquiry', 'referred', 'open', 'lost') as to", "if(event_id % 3 = 0, 'done', null) as resolution")
    return O.conflict_transitions(e)


@query("JOB5_rescan_lifecycle", """
with recursive e as (select event_id // 10 as id, event_id as ord, case when event_type = 'view' then 'assign' when event_type = 'click' then 'close' else 'look' end as what, row_number() over (partition by event_id // 10 order by event_id) as rn from events), t as (
select id, 0::bigint as rn, 0::bigint as ord, 'open' as state, null::varchar as reason_code from (select distinct id from e) union all
select e.id, e.rn, e.ord, case when what = 'assign' and t.state = 'open' then 'assigned' when what = 'close' then 'closed' else t.state end,
 case when what = 'assign' and t.state <> 'open' then 'not_open' when what = 'close' and t.state = 'closed' then 'already_closed' end from t join e on e.id = t.id and e.rn = t.rn + 1)
select id, ord, state, reason_code from t where rn > 0""")
def job5(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id div 10 as id", "event_id as ord", "case when event_type = 'view' then 'assign' when event_type = 'click' then 'close' else 'look' end as what")
    return O.rescan_lifecycle(e)


@query("JOB6_task_lifecycle", """
with recursive e as (select event_id // 12 as id, event_id as ord, 'u' || (user_id % 2) as actor, case when event_type = 'view' then 'claim' when event_type = 'click' then 'skip' when event_type = 'purchase' then 'submit' else 'claim' end as what, row_number() over (partition by event_id // 12 order by event_id) as rn from events), t as (
select id, 0::bigint as rn, 0::bigint as ord, 'free' as state, null::varchar as reason_code from (select distinct id from e) union all
select e.id, e.rn, e.ord, case when t.state = 'closed' then t.state when what = 'claim' then case when t.state = 'free' then 'by:' || actor else t.state end when t.state <> 'by:' || actor then t.state when what = 'submit' then 'closed' else 'free' end,
 case when t.state = 'closed' then 'task_closed' when what = 'claim' and t.state <> 'free' then 'already_claimed' when what <> 'claim' and t.state <> 'by:' || actor then 'not_claimant' end from t join e on e.id = t.id and e.rn = t.rn + 1)
select id, ord, state, reason_code from t where rn > 0""")
def job6(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id div 12 as id", "event_id as ord", "concat('u', user_id % 2) as actor", "case when event_type = 'click' then 'skip' when event_type = 'purchase' then 'submit' else 'claim' end as what")
    return O.task_lifecycle(e)


@query("JOB7_pin_envelopes", "select page_id, case when page_id % 5 = 0 then 'missing_model_version' when page_id % 7 = 0 then 'unknown_model_version' end as reason_code from v_page where page_id % 3 <> 0")
def job7(spark, sf):
    keys = lambda *more: F.map_from_arrays(F.array(*map(F.lit, more)), F.array(*[F.lit("v1")] * len(more)))
    models = F.when(F.col("page_id") % 5 == 0, keys(*O.MODEL_KEYS[:4])).when(F.col("page_id") % 7 == 0, keys(*O.MODEL_KEYS, "other")).otherwise(keys(*O.MODEL_KEYS))
    p = view(spark, sf, "v_page").select("page_id", F.lit(1).alias("ord"), models.alias("models"))
    again = p.withColumn("ord", F.lit(2)).withColumn("models", keys("other"))
    return O.pin_envelopes(p.unionByName(again), p.filter("page_id % 3 = 0")).select("page_id", "reason_code")


@query("JOB10_tag_stream", "select page_id, part_id, actor, case when page_id % 6 = 0 then 'downstream' when page_id % 6 = 1 then 'legacy_digital' when page_id % 10 = 0 then 'audit' else 'routed' end as stream from v_correction")
def job10(spark, sf):
    c = view(spark, sf, "v_correction").withColumn("defect_origin", F.expr("case page_id % 6 when 0 then 'downstream' when 1 then 'legacy' end")).withColumn("source_stream", F.expr("if(page_id % 10 = 0, 'audit', 'routed')"))
    return O.tag_stream(c).select("page_id", "part_id", "actor", "stream")


@query("JOB11_load_closed_sets", "select p_partkey, case when p_partkey % 3 <> 0 then 'provenance_not_allowed' end as reason_code from part")
def job11(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("code"), F.expr("elt(p_partkey % 3 + 1, 'lgd', 'schema', 'lrms')").alias("provenance"))
    return O.load_closed_sets(p, "lgd").select("p_partkey", "reason_code")


#: Two versions of a table of duties per mille by rule key: some keys rise, one is gone, one is new.
DUTIES = """
q as (select distinct p_partkey % 97 as key from part),
duties as (select 'v1' as config_version, key, key % 5 + 10 as value from q where key <> 51 union all select 'v2', key, key % 5 + case when key % 16 = 3 then 12 else 10 end from q where key <> 50),
changed as (select key, o.value as old, n.value as new from (select * from duties where config_version = 'v1') o full join (select * from duties where config_version = 'v2') n using (key) where o.value is distinct from n.value)
"""
DERIVED = f"""
with {DUTIES},
line as (select l_orderkey as record_id, l_partkey % 97 as key, round(l_extendedprice * 100)::bigint as cents from lineitem),
der as (select record_id, v.v as config_version, sum((cents * coalesce(value, 0) + 500) // 1000)::bigint as duty, count(*) as n, sum(cents)::bigint as gross
 from line cross join (values ('v1'), ('v2')) v(v) left join duties d on d.key = line.key and d.config_version = v.v group by 1, 2),
rec as (select record_id, duty, n, case when duty * 1000 > gross * 12 then 'high' else 'low' end as band, config_version from der),
pub as (select *, case when record_id % 4 = 0 then 2 else 1 end as version from rec where config_version = 'v1' and record_id % 23 <> 0 and record_id % 10 <> 7),
hit as (select record_id, count(distinct key) as hits from line where key in (select key from changed) group by 1),
both_ as (select p.record_id, hits, p.version, n.duty, n.n, n.band, concat_ws(',', case when p.duty <> n.duty then 'duty' end, case when p.n <> n.n then 'n' end, case when p.band <> n.band then 'band' end) as changed,
 p.band <> n.band or abs(n.duty - p.duty) * 50 > p.duty as weighty from pub p join hit using (record_id) join (select * from rec where config_version = 'v2') n using (record_id))
"""


def duties(spark, sf):
    q = table(spark, sf, "part").select((F.col("p_partkey") % 97).alias("key")).distinct()
    side = lambda v, gone, rate: q.filter(F.col("key") != gone).select(F.lit(v).alias("config_version"), "key", rate.alias("value"))
    return side("v1", 51, F.col("key") % 5 + 10).unionByName(side("v2", 50, F.col("key") % 5 + F.when(F.col("key") % 16 == 3, 12).otherwise(10)))


def duty_lines(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), (F.col("l_partkey") % 97).alias("key"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))


def derive_duties(lines, rules):
    """A record's duty in minor units, its number of lines and its band, by one version of the rules."""
    d = lines.join(rules.select("key", "value"), "key", "left").withColumn("duty", F.expr("(cents * coalesce(value, 0) + 500) div 1000"))
    g = d.groupBy("record_id").agg(F.sum("duty").alias("duty"), F.count(F.lit(1)).alias("n"), F.sum("cents").alias("gross"))
    return g.select("record_id", "duty", "n", F.when(F.col("duty") * 1000 > F.col("gross") * 12, "high").otherwise("low").alias("band"))


def reprocessing(spark, sf):
    """Published records, their lineage and inputs: some have an earlier version, some are pinned elsewhere, some aren't published."""
    lines, rules = duty_lines(spark, sf), duties(spark, sf)
    first = derive_duties(lines, rules.filter("config_version = 'v1'")).filter("record_id % 23 <> 0")
    version = lambda n, pin: first.withColumn("version", F.lit(n)).withColumn("config_version", pin)
    now = version(1, F.when(F.col("record_id") % 10 == 7, "v0").otherwise("v1")).filter("record_id % 4 <> 0")
    again = first.filter("record_id % 4 = 0")
    now = now.unionByName(again.withColumn("version", F.lit(2)).withColumn("config_version", F.when(F.col("record_id") % 10 == 7, "v0").otherwise("v1")))
    published = now.unionByName(again.withColumn("version", F.lit(1)).withColumn("config_version", F.lit("v1")).withColumn("duty", F.lit(0).cast("bigint")))
    return published, lines.select("record_id", "key"), lines, rules


def weighty(had, got):
    """Another band, or a duty that moves by more than a fiftieth."""
    return (had("band") != got("band")) | (F.abs(got("duty") - had("duty")) * 50 > had("duty"))


def reprocessed(spark, sf):
    published, lineage, lines, rules = reprocessing(spark, sf)
    return R.reprocess(published, lineage, lines, rules, "v1", "v2", derive_duties, ["duty", "n", "band"], weighty, F.lit("2024-01-01").cast("timestamp"))


@query("JOB12_reprocess_diff", DERIVED + "select record_id, case when changed <> '' then 'changed' else 'unchanged' end as kind, changed, hits, version, changed <> '' and weighty as review, duty, n, band from both_")
def job12(spark, sf):
    return reprocessed(spark, sf).changes


@query("JOB12_reprocess_versions", DERIVED + "select record_id, version + 1 as version, 'v2' as config_version, duty, n, band from both_ where changed <> ''")
def job12_versions(spark, sf):
    return reprocessed(spark, sf).versions


@query("JOB12_impact_preview", DERIVED + "select c.key, c.old, c.new, count(distinct p.record_id) as records from changed c left join line l using (key) left join pub p on p.record_id = l.record_id group by 1, 2, 3")
def job12_preview(spark, sf):
    published, lineage, _, rules = reprocessing(spark, sf)
    return R.impact_preview(published, lineage, rules, "v1", "v2", ["record_id"])


WORDS = "case min(field_name) when 'survey_number' then 'Khasra No. ' when 'owner_name' then 'Shri Owner ' when 'share_fraction' then 'hissa 1/' else 'S/o Owner ' end"


def lane_tokens(spark, sf):
    """The boxes of JOI15 with a text of their field's kind."""
    t = dealt(view(spark, sf, "v_token"), "page_id").groupBy("page_id", "token_id", "y").agg(F.min("x").alias("x"), F.min("w").alias("w"), F.min("h").alias("h"), F.min("confidence").alias("confidence"), F.expr(WORDS).alias("word"))
    return t.select("page_id", F.concat_ws("-", "token_id", "y").alias("id"), "x", "y", "w", "h", "confidence", F.concat("word", (F.col("token_id") + 1).cast("string")).alias("text"), F.lit("ror").alias("doc_type"))


LANE = f"""
f as (select page_id, token_id || '-' || y as id, y, min(confidence) as c, token_id, {WORDS} || (token_id + 1) as raw_value, min(field_name) as field_name from v_token group by page_id, token_id, y),
v as (select *, case field_name when 'survey_number' then (token_id + 1)::varchar when 'share_fraction' then '1/' || (token_id + 1) else raw_value end as canonical_value from f),
z as (with {STRIKES} select page_id, id, strokes from k where near),
w as (select v.*, strokes is not null as struck from v left join z using (page_id, id))
"""
LANE_TOK = """
p as (select page_id, id, y, c from v where field_name = 'survey_number'), o as (select page_id, id, y, c from v where field_name = 'owner_name'), s as (select page_id, id, y, c from v where field_name = 'share_fraction'),
np as (select page_id, count(*) as np from p group by 1), no as (select page_id, count(*) as no from o group by 1)
"""


@query("JOB13_text_lane", f"""
with {LANE}, bound as ({BANDS.replace(TOK, LANE_TOK)} select page_id, parcel_id as id, owner_ids, share_id, ambiguous from j)
select page_id, id, field_name, raw_value, canonical_value, 'unknown' as entry_status, struck, owner_ids, share_id, ambiguous from w left join bound using (page_id, id)""")
def job13(spark, sf):
    return O.text_lane(lane_tokens(spark, sf), strokes(spark, sf)).drop("y")


@query("JOB13_text_lane_records", f"""
with {LANE}, c as (select page_id, field_name, count(*) as n, count(distinct canonical_value) as d from w where not struck group by 1, 2)
select page_id as record_id, count(*) as fields, 'single_page' as strategy, concat_ws('; ', string_agg('[CONFLICT] ' || field_name, '; ' order by field_name) filter (d > 1), string_agg('[DUPLICATE] ' || field_name, '; ' order by field_name) filter (n > d)) as rationale from c group by 1""")
def job13_records(spark, sf):
    r = O.text_lane_records(O.text_lane(lane_tokens(spark, sf), strokes(spark, sf)))
    return r.select("record_id", F.size("fields").cast("long").alias("fields"), "strategy", "rationale")


def sheets(spark, sf):
    """Each polygon on a sheet of its own with four control points, the last of them up to 30 m off; every ninth sheet has only two.

    Two of three sheets have a label in the parcel's middle.
    """
    p = polygons(spark, sf).filter("crs = 'EPSG:32643'").withColumn("page_id", F.col("polygon_id"))
    k = F.explode(F.when(F.col("polygon_id") % 9 == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.sequence(F.lit(0), F.lit(3))))
    g = p.select("page_id", k.alias("k")).selectExpr("page_id", "cast(k % 2 * 1000 as double) as pixel_x", "cast(k div 2 * 1000 as double) as pixel_y", "if(k = 3, page_id % 4 * 10, 0) as off")
    g = g.selectExpr("page_id", "pixel_x", "pixel_y", "500000 + 2 * pixel_x + off as geo_x", "3000000 - 2 * pixel_y as geo_y")
    labels = p.filter("polygon_id % 3 <> 0").selectExpr("page_id", "polygon_id as label_id", "concat('S', polygon_id) as text", "x0 + side / 2 as x", "y0 + side / 2 as y")
    return p, labels, g


@query("JOB14_map_lane", """
with p as (select polygon_id, side, polygon_id % 4 as t, case when polygon_id % 9 = 0 then 'not_georeferenced' when not is_closed then 'not_closed' end as invalid from v_polygon where crs = 'EPSG:32643'),
b as (select *, invalid is null and polygon_id % 3 <> 0 as bound from p)
select polygon_id as page_id, polygon_id, invalid, case when bound then 'bound' else 'unbound' end as label_status, case when bound then polygon_id end as label_id, case when bound then 'S' || polygon_id end as text,
 case when invalid is null then (side * side * (4 + t / 100))::decimal(38, 2)::varchar else '0.00' end as area, bound and t = 0 as eligible from b""")
def job14(spark, sf):
    p, labels, gcps = sheets(spark, sf)
    return O.map_lane(p, labels, A.fit_affine(gcps))


@query("STR6_dead_letter", "select event_id as id, case when event_id % 7 > 5 or (event_type = 'error' and event_id % 7 >= 5) then 'dead_letter' when event_type = 'error' then 'retry' else 'done' end as outcome, case when event_id % 7 > 5 or (event_type = 'error' and event_id % 7 >= 5) then 'triage.DLQ' else 'triage' end as queue from events")
def str6(spark, sf):
    return O.dead_letters(table(spark, sf, "events").selectExpr("event_id as id", "'triage' as queue", "event_id % 7 as attempts", "event_type = 'error' as failed"))


@query("STR8_replay_from", "select event_id, user_id from events where event_id > 5000")
def str8(spark, sf):
    return O.replay_from(table(spark, sf, "events"), "event_id", 5000).select("event_id", "user_id")
