"""Queries of the sources and of the row-wise rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from verdigris.functions.hashing import hmac_hash
from verdigris.operators import projections as P
from verdigris.plans.registry import query
from verdigris.plans.views import table, view
from verdigris.sources import files as S

NULLS = "cast(null as varchar)"
DISTRICT = "case when district is null or trim(district) = '' then 'missing_mandatory_field:district'"


@query("SRC1_scan_batch_files", f"select document_id, {DISTRICT} when mime not in ('application/pdf', 'image/jpeg', 'image/png', 'image/tiff') then 'unsupported_mime_type' end as reason_code from v_batch")
def src1(spark, sf):
    return S.accept_batches(view(spark, sf, "v_batch")).select("document_id", "reason_code")


@query("SRC3_content_digest", "select doc_id, sha256(text) as sha256, 'sha256/' || left(sha256(text), 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) as storage_key from documents")
def src3(spark, sf):
    return S.content_digest(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query("SRC4_dedupe_ingest", """
with d as (select doc_id, sha256(text) as sha256 from documents), o as (select * from d where doc_id % 10 = 0), n as (select * from d where doc_id % 10 <> 0),
k as (select sha256, min(doc_id) as known from o group by 1), f as (select sha256, min(doc_id) as first from n group by 1)
select n.doc_id, n.sha256, coalesce(k.known, f.first) as document_id, k.known is null and n.doc_id = f.first as created
from n join f using (sha256) left join k using (sha256)""")
def src4(spark, sf):
    d = S.content_digest(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "sha256")
    return S.dedupe_ingest(d.filter("doc_id % 10 <> 0"), d.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "document_id"))


@query("SRC5_get_or_create_batch", f"""
select batch_id, min(district) as district, {DISTRICT} end as reason_code,
       case when trim(district) = '' then 'refused' when batch_id % 3 = 0 then 'reused' else 'created' end as outcome
from v_batch group by batch_id, district""")
def src5(spark, sf):
    known = table(spark, sf, "nation").filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("batch_id"))
    return S.get_or_create_batch(view(spark, sf, "v_batch"), known)


@query("SRC6_split_document", """
with p as (select doc_id, string_split(text, chr(10)) as parts from documents where doc_id % 7 <> 0)
select doc_id, len(parts)::int as page_count, (i - 1)::int as index, parts[i] as unit from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from p)""")
def src6(spark, sf):
    docs = table(spark, sf, "documents")
    return S.split_document(docs.select("doc_id", "text"), docs.filter("doc_id % 7 = 0").select("doc_id"))


@query("SRC7_fixity_sweep", """
select doc_id, 'primary' as store, 'match' as outcome from documents
union all select doc_id, 'secondary', case when doc_id % 97 = 0 then 'mismatch' else 'match' end from documents""")
def src7(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    manifest = docs.select("doc_id", F.sha2("content", 256).alias("sha256"))
    copy = docs.withColumn("content", F.when(F.col("doc_id") % 97 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    return S.fixity_sweep(manifest, docs, copy)


@query("SRC8_publish_sink", "select o_orderkey, o_orderpriority as target, true as accepted, o_orderpriority || '-' || row_number() over (partition by o_orderpriority order by o_orderkey) as reference from orders")
def src8(spark, sf):
    return S.publish_receipts(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("target")), "o_orderkey", "target")


@query("SRC9_append_queue_envelope", "select 'triage' as queue, 'ingest' as producer, user_id || ':' || event_id as trace_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' as payload from events")
def src9(spark, sf):
    return S.queue_envelopes(table(spark, sf, "events"), "triage", "ingest", "user_id", "event_id", ["event_id", "event_type"])


@query("SRC10_self_fixity", "select doc_id, doc_id % 89 <> 0 as ok from documents")
def src10(spark, sf):
    d = S.content_digest(table(spark, sf, "documents").select("doc_id", "text"), "text")
    key = F.when(F.col("doc_id") % 89 == 0, F.concat("storage_key", F.lit("0"))).otherwise(F.col("storage_key"))
    return S.self_fixity(d.select("doc_id", F.col("text").alias("content"), key.alias("path"))).select("doc_id", "ok")


@query("PRJ1_contract_violations", """
select id, 'legibility_band' as rule from v_extraction where legibility_band not in ('good', 'marginal', 'poor')
union all select id, 'entry_status' from v_extraction where entry_status not in ('amended', 'cancelled', 'live', 'superseded', 'unknown')
union all select id, 'routing_outcome' from v_extraction where routing_outcome not in ('audit_sample', 'auto_accept', 'conflict', 'outside_calibrated_regime', 'review')""")
def prj1(spark, sf):
    return P.violations(view(spark, sf, "v_extraction"), ["id"], P.extraction_contract())


@query("PRJ2_force_not_applicable", "select extraction_id, validator, case when consumed_constraint is not null then 'not_applicable' else verdict end as verdict from v_validation")
def prj2(spark, sf):
    v = view(spark, sf, "v_validation").withColumn("consumed_constraints", F.array_compact(F.array("consumed_constraint")))
    return P.force_not_applicable(v).select("extraction_id", "validator", "verdict")


@query("PRJ3_mark_live", "select id, case when entry_status = 'unknown' then 'live' else entry_status end as new_status, case when entry_status <> 'unknown' then 'entry_status_not_unknown' end as reason_code from v_extraction")
def prj3(spark, sf):
    return P.mark_live(view(spark, sf, "v_extraction")).select("id", "new_status", "reason_code")


HIDE = "field_name in ('address', 'owner_name', 'relationship')"


@query("PRJ4_mask", f"""
select id, case when {HIDE} then '•••' else trim(raw_value) end as value, case when {HIDE} then '•••' else raw_value end as raw_value,
       case when not ({HIDE}) then 'crop/' || id end as crop_uri, {HIDE} as masked from v_extraction""")
def prj4(spark, sf):
    e = view(spark, sf, "v_extraction").select("id", "field_name", F.trim("raw_value").alias("value"), "raw_value", F.concat(F.lit("crop/"), "id").alias("crop_uri"))
    return P.mask(e, "reviewer").drop("field_name")


@query("PRJ5_mask_history", """
select page_id, part_id, field_class, string_agg(case when field_class = 'owner_name' then '•••>•••' else predicted || '>' || corrected end, ';' order by created_at, predicted, corrected) as history
from v_correction group by 1, 2, 3""")
def prj5(spark, sf):
    h = view(spark, sf, "v_correction").groupBy("page_id", "part_id", "field_class").agg(F.array_sort(F.collect_list(F.struct("created_at", "predicted", "corrected"))).alias("history"))
    return P.mask_history(h, "reviewer").withColumn("history", F.array_join(F.transform("history", lambda x: F.concat_ws(">", x["predicted"], x["corrected"])), ";"))


@query("PRJ6_public_view", "select id, assignee, strftime(opened_at, '%Y-%m-%dT%H:%M:%S') as opened_at, strftime(closed_at, '%Y-%m-%dT%H:%M:%S') as closed_at from v_task")
def prj6(spark, sf):
    return P.public_view(view(spark, sf, "v_task"), ["id", "assignee", "opened_at", "closed_at"], ("opened_at", "closed_at"))


GRANTS = {"reviewer": ["record.read", "task.claim"], "officer": ["record.read", "conflict.resolve", "record.publish"], "auditor": ["audit.read", "record.read_unmasked"], "admin": ["config.write", "config.approve"], "viewer": ["record.read"]}
ROLE = "case user_id % 5 when 0 then 'reviewer' when 1 then 'officer' when 2 then 'auditor' when 3 then 'admin' else 'viewer' end"


@query("PRJ7_permissions_for", f"""
with m as (select * from (values {", ".join(f"('{r}', '{p}')" for r, ps in GRANTS.items() for p in ps)}) t(role, permission)),
i as (select distinct user_id, {ROLE} as role from events union select distinct user_id, 'viewer' from events where event_id % 4 = 0),
g as (select distinct user_id, permission from i join m using (role)),
a as (select distinct user_id, case event_type when 'view' then 'record.read' when 'click' then 'task.claim' else 'record.publish' end as permission from events)
select a.user_id as "user", permission, g.user_id is not null as allowed, case when g.user_id is not null then 'rbac.checked' else 'rbac.denied' end as action from a left join g using (user_id, permission)""")
def prj7(spark, sf):
    e = table(spark, sf, "events")
    who = e.select(F.col("user_id").alias("user"), F.expr(ROLE).alias("role")).union(e.filter("event_id % 4 = 0").select("user_id", F.lit("viewer"))).distinct()
    asked = e.select(F.col("user_id").alias("user"), F.expr("case event_type when 'view' then 'record.read' when 'click' then 'task.claim' else 'record.publish' end").alias("permission")).distinct()
    return P.check_permissions(asked, P.permissions_for(who, P.matrix(spark, GRANTS)))


@query("PRJ8_unmasked_read", "select 'field.unmasked_read' as action, page_id || ':1:' || field_name as subject, 'audit ' || index_position as purpose from v_extraction where index_position % 3 <> 0")
def prj8(spark, sf):
    e = view(spark, sf, "v_extraction").withColumn("purpose", F.expr("if(index_position % 3 = 0, '  ', concat('audit ', index_position))")).withColumn("version", F.lit(1)).withColumnRenamed("page_id", "record_id")
    return P.unmasked_read(e)[1]


LANES = """
select page_id, 'TEXT' as lane from v_page where page_role in ('endorsement', 'tabular_register', 'text')
union all select page_id, 'MAP' from v_page where page_role <> 'blank' and (page_role = 'map_sheet' or doc_type in ('cadastral_map', 'fmb_sketch'))"""


@query("PRJ9_lane_for", LANES)
def prj9(spark, sf):
    return P.lanes(view(spark, sf, "v_page")).select("page_id", "lane")


@query("SET1_fork_lanes", f"with l as ({LANES}) select lane, count(*) as n, count(distinct page_id) as pages from l group by lane")
def set1(spark, sf):
    return P.lanes(view(spark, sf, "v_page")).groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


REGION = "case page_id % 4 when 0 then 'map' when 1 then 'table' when 2 then 'handwritten' else 'stamp' end"


def regions(spark, sf):
    given = F.when(F.col("page_id") % 3 == 0, F.array(F.struct(F.expr(REGION).alias("type"), F.lit(0.5).alias("confidence")), F.struct(F.lit("table").alias("type"), F.lit(None).cast("double").alias("confidence"))))
    return view(spark, sf, "v_page").withColumn("regions", given)


REGIONS = f"""
select page_id, 0 as position, case {REGION} when 'map' then 'map' when 'table' then 'table' when 'handwritten' then 'handwritten_text' else 'printed_text' end as route, 0.5::double as confidence, false as fallback_applied from v_page where page_id % 3 = 0
union all select page_id, 1, 'table', 1.0, false from v_page where page_id % 3 = 0
union all select page_id, 0, case page_role when 'map_sheet' then 'map' when 'tabular_register' then 'table' when 'endorsement' then 'handwritten_text' else 'printed_text' end,
  case page_role when 'map_sheet' then 0.95 when 'tabular_register' then 0.9 when 'endorsement' then 0.85 else 1.0 end, page_role not in ('map_sheet', 'tabular_register', 'endorsement') from v_page where page_id % 3 <> 0"""


@query("PRJ10_route_regions", REGIONS)
def prj10(spark, sf):
    return P.route_regions(regions(spark, sf))


@query("PRJ11_check_payload_drift", """
select id, 'routing_outcome' || case when index_position = 4 then ',calibrated_confidence' else '' end as fields from v_extraction where index_position % 4 = 0 and routing_outcome is not null""")
def prj11(spark, sf):
    state = view(spark, sf, "v_extraction").select("id", "routing_outcome", F.col("token_confidence").alias("calibrated_confidence"), "index_position")
    m = state.withColumn("routing_outcome", F.expr("if(index_position % 4 = 0 and routing_outcome is not null, concat(routing_outcome, '!'), if(index_position = 2, null, routing_outcome))"))
    m = m.withColumn("calibrated_confidence", F.expr("if(index_position = 4 and routing_outcome is not null, calibrated_confidence + 1, if(index_position = 1, null, calibrated_confidence))"))
    return P.payload_drift(m, state, "id", ["routing_outcome", "calibrated_confidence"])


@query("PRJ12_unit_convert", """
select p_partkey, n_name as district, p_size * case when n_nationkey % 2 = 0 then 1008.0::double end as area_m2, case when n_nationkey % 2 <> 0 then 'no_unit_table_for_district' end as reason_code
from part join nation on n_nationkey = p_partkey % 25""")
def prj12(spark, sf):
    n = table(spark, sf, "nation")
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("amount"), (F.col("p_partkey") % 25).alias("n_nationkey"))
    units = n.filter("n_nationkey % 2 = 0").select(F.concat(F.lit(" "), F.lower("n_name")).alias("district"), F.lit(P.UNIT_M2["bigha"]).alias("m2"))
    return P.unit_convert(p.join(n.select("n_nationkey", F.col("n_name").alias("district")), "n_nationkey").drop("n_nationkey"), units).drop("amount")


@query("PRJ13_envelope_errors", "select event_id, case event_id % 4 when 0 then 'payload,trace_id' when 1 then 'producer' when 2 then 'emitted_at,message_id' end as missing from events where event_id % 4 <> 3")
def prj13(spark, sf):
    e = table(spark, sf, "events")
    full = {"message_id": "1", "trace_id": "2", "emitted_at": "3", "producer": "4", "payload": "5"}
    gone = [("payload", "trace_id"), ("producer",), ("emitted_at", "message_id"), ()]
    import json

    texts = [json.dumps({k: v for k, v in full.items() if k not in g}) for g in gone]
    m = e.select("event_id", F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 4 + 1).cast("int")).alias("message"))
    return S.envelope_errors(m, "message").select("event_id", "missing")


SHARD = "('0x' || right(sha256('district:' || district), 1))::int % 8"
KEY = b"land"
PADS = [bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


def hmac_sql(c):
    return f"sha256(unhex('{PADS[1]}' || sha256(unhex('{PADS[0]}' || hex({c})))))"


@query("PRJ14_audit_rows", f"select 'record.edited' as action, id as subject, {NULLS} as purpose, {hmac_sql('action')} as value_hash, district, {SHARD} as shard_id from (select id::varchar as id, action, district from v_audit)")
def prj14(spark, sf):
    return P.audit_rows(view(spark, sf, "v_audit"), "record.edited", F.col("id"), F.col("district"), F.col("action"), KEY)


@query("SCA12_hmac_hash", f"select c_custkey, {hmac_sql('c_name')} as value_hash, {hmac_sql("c_name || ' ' || c_mktsegment")} as edit_hash from customer")
def sca12(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", hmac_hash(F.col("c_name"), KEY).alias("value_hash"), hmac_hash(F.concat_ws(" ", "c_name", "c_mktsegment"), KEY).alias("edit_hash"))


@query("SCA11_shard_for", f"select id, {SHARD} as shard_id from v_audit")
def sca11(spark, sf):
    from verdigris.functions.hashing import shard_for, shard_key

    return view(spark, sf, "v_audit").select("id", shard_for(shard_key(F.col("district"), F.lit(None).cast("string"))).alias("shard_id"))


def scratch(name: str) -> str:
    return f"{name}-{uuid.uuid4().hex}"
