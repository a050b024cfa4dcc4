"""Queries of the audit chain, windows, folds, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions.hashing import shard_for, shard_key
from verdigris.operators import aggs as A
from verdigris.operators import folds as L
from verdigris.operators import sampling as S
from verdigris.plans.registry import query
from verdigris.plans.views import table, view


def audit(spark, sf):
    """Entries of eight shards; purpose and value_hash partly null."""
    v = view(spark, sf, "v_audit").withColumn("purpose", F.expr("if(id % 3 = 0, 'check', null)")).withColumn("value_hash", F.expr("if(id % 2 = 0, sha2(action, 256), null)"))
    return v.withColumn("shard_id", shard_for(shard_key(F.concat("district", F.lit("-"), (F.col("id") % 23).cast("string")), F.lit(None).cast("string"))))


def chained(spark, sf):
    """The audit entries of the first days, linked."""
    return L.append_chain(audit(spark, sf))


SHARD = "('0x' || right(sha256('district:' || district || '-' || (id % 23)), 1))::int % 8"
ISO = "strftime(\"at\", '%Y-%m-%dT%H:%M:%S') || case when epoch_us(\"at\") % 1000000 = 0 then '' else '.' || lpad((epoch_us(\"at\") % 1000000)::varchar, 6, '0') end || '+00:00'"
CHAIN = f"""
with recursive a as (select *, {SHARD} as shard_id, concat_ws('|', actor, action, subject, case when id % 3 = 0 then 'check' else '' end, case when id % 2 = 0 then sha256(action) else '' end, {ISO}) as body from v_audit),
n as (select *, row_number() over (partition by shard_id order by "at", id) as rn from a),
ch as (select shard_id, id, "at", rn, cast(null as varchar) as prev_hash, sha256('|' || body) as hash from n where rn = 1
 union all select n.shard_id, n.id, n."at", n.rn, ch.hash, sha256(ch.hash || '|' || n.body) from ch join n on n.shard_id = ch.shard_id and n.rn = ch.rn + 1),
"""
ROOT = """
hd as (select s.s::int as shard_id, h.head from range(8) s(s) left join (select shard_id, arg_max(hash, ("at", id)) as head from ch group by 1) h on h.shard_id = s.s),
lv as (select shard_id as p, sha256(shard_id || ':' || coalesce(head, '')) as h from hd),
l1 as (select a.p // 2 as p, sha256(a.h || b.h) as h from lv a join lv b on b.p = a.p + 1 where a.p % 2 = 0),
l2 as (select a.p // 2 as p, sha256(a.h || b.h) as h from l1 a join l1 b on b.p = a.p + 1 where a.p % 2 = 0),
rt as (select sha256(a.h || b.h) as root from l2 a join l2 b on b.p = 1 where a.p = 0)
"""


@query("WIN1_append_chain", CHAIN.rstrip().rstrip(",") + " select shard_id, id, prev_hash, hash from ch")
def win1(spark, sf):
    return chained(spark, sf).select("shard_id", "id", "prev_hash", "hash")


def tampered(spark, sf):
    return chained(spark, sf).withColumn("actor", F.expr("if(id % 1009 = 500 and shard_id <> 3, 'x', actor)"))


@query("WIN2_verify_chain", CHAIN + """
b as (select n.shard_id, n.id, n."at", n.id % 1009 = 500 and n.shard_id <> 3 as bad from n)
select shard_id, arg_min(id, ("at", id)) filter (bad) as first_bad, count(*) as n from b group by 1""")
def win2(spark, sf):
    return L.verify_chain(tampered(spark, sf))


@query("AGG14_shard_heads", CHAIN + ROOT + " select shard_id, head from hd")
def agg14(spark, sf):
    return A.shard_heads(spark, chained(spark, sf))


@query("AGG15_merkle_root", CHAIN + ROOT + " select root from rt")
def agg15(spark, sf):
    return A.merkle_root(A.shard_heads(spark, chained(spark, sf)))


@query("WIN3_verify_against_root", CHAIN + ROOT + " select true as structure_ok, root, false as anchor_ok, false as ok from rt")
def win3(spark, sf):
    return L.verify_against_root(spark, chained(spark, sf), "0" * 64)


ROLLS = """
lr as (select time_bucket(interval 1 day, "at") + interval 1 day as rolled_at, shard_id, arg_max(hash, ("at", id)) as hash from ch group by 1, 2),
sp as (select r.rolled_at, s.s::int as shard_id from (select distinct rolled_at from lr) r, range(8) s(s)),
hs as (select sp.rolled_at, sp.shard_id, last_value(hash ignore nulls) over (partition by sp.shard_id order by sp.rolled_at rows between unbounded preceding and current row) as head from sp left join lr using (rolled_at, shard_id))
"""


@query("WIN5_roll_roots", CHAIN + ROLLS + """,
lf as (select rolled_at, shard_id as p, sha256(shard_id || ':' || coalesce(head, '')) as h from hs),
x1 as (select a.rolled_at, a.p // 2 as p, sha256(a.h || b.h) as h from lf a join lf b on b.p = a.p + 1 and a.rolled_at = b.rolled_at where a.p % 2 = 0),
x2 as (select a.rolled_at, a.p // 2 as p, sha256(a.h || b.h) as h from x1 a join x1 b on b.p = a.p + 1 and a.rolled_at = b.rolled_at where a.p % 2 = 0)
select a.rolled_at, sha256(a.h || b.h) as root from x2 a join x2 b on b.p = 1 and a.rolled_at = b.rolled_at where a.p = 0""")
def win5(spark, sf):
    return L.roll_roots(chained(spark, sf), "1 day").select(F.col("rolled_at").cast("timestamp_ntz").alias("rolled_at"), "root")


@query("WIN4_tamper_window", CHAIN + ROLLS + """,
gone as (select hash from ch where id % 7 = 3), m as (select shard_id, rolled_at, head, head in (select hash from gone) as missing from hs where head is not null),
f as (select shard_id, min(rolled_at) filter (missing) as first_missing from m group by 1)
select m.shard_id, first_missing, max(m.rolled_at) filter (not missing and m.rolled_at < first_missing) as last_agreeing from m join f using (shard_id) where first_missing is not null group by 1, 2""")
def win4(spark, sf):
    c = chained(spark, sf)
    t = L.tamper_window(L.roll_roots(c, "1 day"), c.filter("id % 7 <> 3"))
    return t.select("shard_id", *[F.col(k).cast("timestamp_ntz").alias(k) for k in ("first_missing", "last_agreeing")])


SESSIONS = """
g as (select actor, "at", id, case when "at" - lag("at") over (partition by actor order by "at", id) > interval 1 hour then 1 else 0 end as new from v_audit),
s as (select actor, "at", id, sum(new) over (partition by actor order by "at", id) as session from g)
"""


@query("WIN6_review_sessions", f"with {SESSIONS} select id, actor, session::bigint as session, floor(epoch_us(\"at\" - min(\"at\") over (partition by actor, session)) / 3600000000)::bigint as hour_into_session from s")
def win6(spark, sf):
    return L.review_sessions(view(spark, sf, "v_audit")).select("id", "actor", "session", "hour_into_session")


ALERTS = """
with recursive e as (select user_id as key, ts as t, row_number() over (partition by user_id order by ts, event_id) as rn from events where event_type in ('error', 'click')),
w as (select key, t, rn, t as opened from e where rn = 1 union all select e.key, e.t, e.rn, case when w.opened >= e.t - interval 6 hour then w.opened else e.t end from w join e on e.key = w.key and e.rn = w.rn + 1)
select key, opened, count(*) as n from w group by 1, 2"""


@query("WIN7_novelty_alerts", ALERTS)
def win7(spark, sf):
    e = table(spark, sf, "events").filter("event_type in ('error', 'click')").selectExpr("user_id as key", "ts as at", "event_id as id")
    return L.novelty_alerts(e).withColumn("opened", F.col("opened").cast("timestamp_ntz"))


@query("WIN8_supersede_configs", "select id, scope, key, case when author <> approver then lead(id) over (partition by scope, key, author = approver order by effective_from, id) end as superseded_by, case when author = approver then 'author_is_approver' end as reason_code from v_config")
def win8(spark, sf):
    return L.supersede_configs(view(spark, sf, "v_config")).select("id", "scope", "key", "superseded_by", "reason_code")


@query("WIN9_next_versions", """
with p as (select o_custkey as record_group, o_orderkey as id, o_orderdate as t, case when o_orderkey % 3 = 0 then 'U' || o_orderkey end as ulpin from orders)
select record_group, id, row_number() over w + case when record_group % 4 = 0 then 5 else 0 end as version, last_value(ulpin ignore nulls) over (partition by record_group order by t, id rows between unbounded preceding and current row) as ulpin from p window w as (partition by record_group order by t, id)""")
def win9(spark, sf):
    p = table(spark, sf, "orders").selectExpr("o_custkey as record_group", "o_orderkey as id", "o_orderdate as at", "if(o_orderkey % 3 = 0, concat('U', o_orderkey), null) as ulpin")
    have = p.filter("record_group % 4 = 0").select("record_group", F.lit(5).alias("version")).distinct()
    return L.next_versions(p, have, ["ulpin"]).select("record_group", "id", "version", "ulpin")


@query("WIN10_cluster_cuts", """
with recursive c as (select distinct page_id as key, y as c from v_token), r as (select *, row_number() over (partition by key order by c) as rn from c), b as (select page_id as key, min(y) as lo, max(y + h) as hi from v_token group by 1),
f as (select key, rn, c as kept, true as keep, c from r where rn = 1 union all select r.key, r.rn, case when r.c - f.kept < 8 then f.kept else r.c end, r.c - f.kept >= 8, r.c from f join r on r.key = f.key and r.rn = f.rn + 1),
g as (select key, list(c order by c) filter (keep) as cuts from f group by 1)
select key, array_to_string(list_transform(case when len(cuts) < 2 then [lo, hi] else cuts end, lambda x: x::int), ',') as cuts from g join b using (key)""")
def win10(spark, sf):
    t = view(spark, sf, "v_token")
    d = L.cluster_cuts(t.select(F.col("page_id").alias("key"), F.col("y").alias("c"), F.col("y").alias("lo"), (F.col("y") + F.col("h")).alias("hi")))
    return d.withColumn("cuts", F.array_join(F.col("cuts").cast("array<int>").cast("array<string>"), ","))


EVIDENCE = "select user_id as scope, event_id as ord, (event_id % 7)::int as n, event_id % 5 <> 0 as calibrated, event_id % 3 <> 0 as target_met, event_id % 11 = 0 as alert, event_id % 2 = 0 as recovered from events"


@query("WIN12_cold_start_states", f"""
with recursive e as (select *, row_number() over (partition by scope order by ord) as rn from ({EVIDENCE})), t as (
select scope, 0::bigint as rn, 'shadow' as state from (select distinct scope from e) union all
select e.scope, e.rn, case t.state when 'shadow' then case when n >= 3 then 'ramp' else 'shadow' end
 when 'ramp' then case when alert then 'regression' when n >= 3 and calibrated and target_met then 'steady' else 'ramp' end
 when 'steady' then case when alert then 'regression' else 'steady' end
 else case when recovered and n >= 3 and not alert then 'ramp' else 'regression' end end from t join e on e.scope = t.scope and e.rn = t.rn + 1)
select scope, arg_max(state, rn) as state, arg_max(state, rn) = 'steady' as auto_accept_allowed, arg_max(state, rn) in ('ramp', 'regression') as elevated_sampling from t group by 1""")
def win12(spark, sf):
    e = table(spark, sf, "events").selectExpr("user_id as scope", "event_id as ord", "cast(event_id % 7 as int) as n", "event_id % 5 <> 0 as calibrated", "event_id % 3 <> 0 as target_met", "event_id % 11 = 0 as alert", "event_id % 2 = 0 as recovered")
    return L.cold_start_states(e)


@query("WIN13_next_band", """
with b as (select page_id, token_id as id, min(y) as y, case when token_id % 5 = 0 then null else min(h) end as h from v_token group by 1, 2), c as (select *, coalesce(y + h / 2, 0) as center from b)
select page_id, id, center, lead(center, 1, 'infinity'::double) over (partition by page_id order by center, id) as next_center from c""")
def win13(spark, sf):
    b = view(spark, sf, "v_token").groupBy("page_id", F.col("token_id").alias("id")).agg(F.min("y").alias("y"), F.expr("if(token_id % 5 = 0, null, min(h))").alias("h"))
    return L.next_band(b).select("page_id", "id", "center", "next_center")


@query("TOP1_claim_next", """
with t as (select id, row_number() over (order by opened_at, id) as n from v_task where assignee is null and closed_at is null), a as (select user_id as actor, row_number() over (order by min(ts), user_id) as n from events group by 1)
select id, actor from t join a using (n)""")
def top1(spark, sf):
    asked = table(spark, sf, "events").groupBy(F.col("user_id").alias("actor")).agg(F.min("ts").alias("asked_at"))
    return S.claim_next(view(spark, sf, "v_task"), asked)


@query("TOP2_open_tasks", "select id, opened_at from v_task where closed_at is null order by opened_at, id")
def top2(spark, sf):
    return S.open_rows(view(spark, sf, "v_task").filter("closed_at IS NULL")).select("id", "opened_at")


@query("TOP2_list_conflicts", "select id, rule, opened_at from v_conflict where state = 'open'")
def top2b(spark, sf):
    return S.open_rows(view(spark, sf, "v_conflict").filter("state = 'open'")).select("id", "rule", "opened_at")


@query("TOP3_aged", "select id, state, opened_at from v_conflict where state in ('open', 'under_enquiry', 'referred') and opened_at < timestamp '1998-01-01' - interval 90 day")
def top3(spark, sf):
    return S.aged(view(spark, sf, "v_conflict"), F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")), "90 days").select("id", "state", "opened_at")


@query("TOP4_drain", "select o_orderkey as id, true as dispatched, (o_orderkey % 3 + 1)::int as attempts from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 100")
def top4(spark, sf):
    box = table(spark, sf, "orders").selectExpr("o_orderkey as id", "o_orderdate as created_at", "o_orderstatus <> 'O' as dispatched", "cast(o_orderkey % 3 as int) as attempts")
    return S.drain(box, 100).select("id", "dispatched", "attempts")


@query("TOP5_top_k", """
with r as (select page_id, raw_value, token_confidence, row_number() over (partition by page_id order by token_confidence desc, raw_value desc) as n from v_extraction)
select page_id, string_agg(raw_value, '|' order by n) as readings from r where n <= 3 group by 1""")
def top5(spark, sf):
    e = view(spark, sf, "v_extraction").select("page_id", F.col("raw_value").alias("value"), F.col("token_confidence").alias("confidence"))
    return S.top_k(e, "page_id", 3).select("page_id", F.array_join(F.transform("top_k", lambda x: x["value"]), "|").alias("readings"))


@query("TOP6_audit_sample", """
select id, legibility_band, ('0x' || left(sha256(id), 8))::bigint / 4294967296.0::double < case when legibility_band = 'poor' then 0.2 else 0.05 end as sampled from v_extraction where routing_outcome = 'auto_accept'""")
def top6(spark, sf):
    e = view(spark, sf, "v_extraction").filter("routing_outcome = 'auto_accept'").withColumn("elevated", F.col("legibility_band") == "poor")
    return S.audit_sample(e).select("id", "legibility_band", "sampled")


@query("UDF4_register_sampler", "select id, right(sha256(id), 1) = '0' as selected from v_extraction")
def udf4(spark, sf):
    from verdigris.operators.plugins import select_audit

    return select_audit(view(spark, sf, "v_extraction"), lambda c: F.substring(F.sha2(c, 256), 64, 1) == "0").select("id", "selected")


@query("SET2_split_train_eval", """
with d as (select doc_id, sha256(text) as digest from documents), r as (select digest, row_number() over (order by digest) as n, count(*) over () as total from (select distinct digest from d))
select doc_id, case when total > 1 and n > total - greatest(1, floor(total * 0.2)) then 'eval' else 'train' end as part from d join r using (digest)""")
def set2(spark, sf):
    return S.split_train_eval(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest")), 0.2).select("doc_id", "part")


@query("SET4_overlap", "select sha256(text) as digest from documents where doc_id % 2 = 0 intersect select sha256(text) from documents where doc_id % 2 = 1")
def set4(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.filter("doc_id % 2 = 0").select("digest").intersect(d.filter("doc_id % 2 = 1").select("digest"))
