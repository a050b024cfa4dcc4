"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import aggs as A
from verdigris.operators import joins as J
from verdigris.operators.projections import route_regions
from verdigris.operators.shared import dealt
from verdigris.plans.joins import PASSES, WORDS, cells, passes, people, polygons, words
from verdigris.plans.registry import query
from verdigris.plans.sources import REGIONS, regions
from verdigris.plans.views import table, view


@query("AGG1_page_activity", """
select coalesce(district, '') as district, "at"::date as day, count_if(action = 'page.ingested')::bigint as pages_ingested, count_if(action = 'page.processed')::bigint as pages_processed, count_if(action = 'record.published')::bigint as records_published
from v_audit where action in ('page.ingested', 'page.processed', 'record.published') group by 1, 2""")
def agg1(spark, sf):
    return A.page_activity(view(spark, sf, "v_audit"))


def positions(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").cast("int").alias("position"))


COMPLETE = """
g as (select l_orderkey as batch_id, list_sort(list(l_linenumber::int)) as observed from lineitem group by 1),
e as (select batch_id, observed, list_filter(range(list_min(observed), list_max(observed) + 1), lambda x: not list_contains(observed, x::int)) as gaps from g)
"""


@query("AGG2_volume_completeness", f"with {COMPLETE} select batch_id, array_to_string(observed, ',') as observed, array_to_string(gaps, ',') as gaps, case when batch_id % 13 = 0 then 'acknowledged' when len(gaps) > 0 then 'gap_detected' else 'complete' end as state from e")
def agg2(spark, sf):
    p = positions(spark, sf)
    return A.volume_completeness(p, p.filter("batch_id % 13 = 0")).withColumn("observed", F.array_join(F.col("observed").cast("array<string>"), ",")).withColumn("gaps", F.array_join(A.numbers_of(F.col("gaps")).cast("array<string>"), ","))


@query("SET3_gaps", f"with {COMPLETE} select batch_id, unnest(gaps)::int as gap from e")
def set3(spark, sf):
    return A.volume_completeness(positions(spark, sf)).select("batch_id", F.explode(A.numbers_of(F.col("gaps"))).alias("gap"))


@query("AGG3_page_terminal", """
select page_id from v_extraction where page_id % 3 <> 0 group by 1 having bool_and(coalesce(routing_outcome in ('audit_sample', 'auto_accept', 'conflict', 'outside_calibrated_regime', 'review'), false))""")
def agg3(spark, sf):
    e = view(spark, sf, "v_extraction")
    return A.page_terminal(e, e.filter("page_id % 3 = 0").select("page_id"))


ECE = "b as (select stratum, least(floor(prediction * 10), 9) as bin, count(*) as n, avg(is_correct::int) as acc, avg(prediction) as conf from v_label_obs where is_correct is not null group by 1, 2)"


def labelled(spark, sf):
    return view(spark, sf, "v_label_obs").filter("is_correct IS NOT NULL")


@query("AGG4_ece", "with b as (select least(floor(prediction * 10), 9) as bin, count(*) as n, avg(is_correct::int) as acc, avg(prediction) as conf from v_label_obs where is_correct is not null group by 1) select sum(n)::bigint as n, round(sum(n * abs(acc - conf)) / sum(n), 6) as ece from b")
def agg4(spark, sf):
    return A.ece(labelled(spark, sf), [], "prediction", "is_correct").withColumn("ece", F.round("ece", 6))


@query("AGG5_evaluate_calibration", f"with {ECE}, s as (select stratum, sum(n)::bigint as n, sum(n * abs(acc - conf)) / sum(n) as ece from b group by 1) select stratum, n, round(ece, 6) as ece, case when n >= 30 then 'stratum_specific' else 'pooled_fallback' end as regime, ece <= 0.3 as acceptable from s")
def agg5(spark, sf):
    return A.evaluate_calibration(labelled(spark, sf), 0.3).withColumn("ece", F.round("ece", 6))


@query("AGG6_stratum_counts", "select stratum, count(*) as n, count(*) >= 5 as own_model from v_label_obs group by 1")
def agg6(spark, sf):
    return A.stratum_counts(view(spark, sf, "v_label_obs"), 5)


def members(spark, sf):
    return view(spark, sf, "v_extraction").selectExpr("page_id as record_id", "cast(index_position as int) as page_index", "field_name", "raw_value as value", "id", "id as ord")


@query("AGG7_assemble_records", """
with e as (select page_id as record_id, index_position::int as page_index, field_name, raw_value as value, id from v_extraction),
o as (select record_id, field_name, value, min((page_index, id)) as pos, count(*) as n from e group by 1, 2, 3),
f as (select record_id, field_name, string_agg(value, '|' order by pos) as vals, count(*) as k, sum(n) as n from o group by 1, 2),
r as (select record_id, string_agg(field_name || '=' || vals, ';' order by field_name) as fields, list(field_name order by field_name) filter (k > 1) as conf, list(field_name order by field_name) filter (n > k) as dup from f group by 1),
p as (select record_id, list_sort(list(distinct page_index)) as pages, string_agg(id, ',' order by page_index, id) as ids from e group by 1),
m as (select *, list_filter(range(list_min(pages), list_max(pages) + 1), lambda x: not list_contains(pages, x::int)) as missing from p)
select record_id, fields, ids, array_to_string(missing, ',') as missing, case when len(pages) > 1 then 'continuation' else 'single_page' end as strategy,
 array_to_string(list_concat(list_concat(list_transform(missing, lambda x: '[MISSING_PAGE_GAP] page ' || x), coalesce(list_transform(conf, lambda x: '[CONFLICT] ' || x), [])), coalesce(list_transform(dup, lambda x: '[DUPLICATE] ' || x), [])), '; ') as rationale
from m join r using (record_id)""")
def agg7(spark, sf):
    d = A.assemble_records(members(spark, sf))
    return d.select("record_id", F.array_join(F.transform("fields", lambda f: F.concat(f["field_name"], F.lit("="), F.array_join(f["values"], "|"))), ";").alias("fields"), F.array_join("ids", ",").alias("ids"), F.array_join(A.numbers_of(F.col("missing")).cast("array<string>"), ",").alias("missing"), "strategy", "rationale")


@query("AGG8_binding_confidence", "select page_id, round(avg(confidence) + 1e-9, 2) as confidence from v_token group by 1")
def agg8(spark, sf):
    return A.binding_confidence(view(spark, sf, "v_token").withColumn("confidence", F.col("confidence") + 1e-9), "page_id")


@query("AGG9_dominant_route", f"with r as ({REGIONS}), g as (select page_id, route, count(*) as n, min(position) as first from r group by 1, 2) select page_id, arg_max(route, (n, -first)) as route from g group by 1")
def agg9(spark, sf):
    return A.dominant_route(route_regions(regions(spark, sf)))


FIT = """
m as (select page_id, count(*) as n, avg(pixel_x) as mx, avg(pixel_y) as my, avg(geo_x) as mu, avg(geo_y) as mv from v_gcp group by 1),
c as (select g.page_id, n, mx, my, mu, mv, pixel_x - mx as x, pixel_y - my as y, geo_x - mu as u, geo_y - mv as v from v_gcp g join m using (page_id)),
s as (select page_id, n, mx, my, mu, mv, sum(x*x) as xx, sum(x*y) as xy, sum(y*y) as yy, sum(x*u) as xu, sum(y*u) as yu, sum(x*v) as xv, sum(y*v) as yv from c group by all),
k as (select *, xx * yy - xy * xy as det, n >= 3 and xx * yy - xy * xy > 1e-9 * greatest(1e-12, xx * yy) as ok from s),
f as (select page_id, n, case when ok then (xu * yy - yu * xy) / det end as a, case when ok then (yu * xx - xu * xy) / det end as b, case when ok then (xv * yy - yv * xy) / det end as d, case when ok then (yv * xx - xv * xy) / det end as e, mx, my, mu, mv from k),
h as (select page_id, n, a, b, mu - a * mx - b * my as c, d, e, mv - d * mx - e * my as f from f),
r as (select page_id, sqrt(avg(pow(geo_x - a * pixel_x - b * pixel_y - c, 2) + pow(geo_y - d * pixel_x - e * pixel_y - f, 2))) as rmse from v_gcp join h using (page_id) group by 1)
"""


@query("AGG10_fit_affine", f"with {FIT} select page_id, n, round(a + 1e-7, 2) as a, round(b + 1e-7, 2) as b, round(d + 1e-7, 2) as d, round(e + 1e-7, 2) as e, round(round(rmse, 4) + 1e-6, 1) as rmse, case when n < 3 then 'too_few_points' when a is null then 'degenerate_points' end as reason_code from h join r using (page_id)")
def agg10(spark, sf):
    r = lambda x, c: F.round(x, 2).alias(c)
    return A.fit_affine(view(spark, sf, "v_gcp")).select("page_id", "n", *[r(F.col(c) + 1e-7, c) for c in "abde"], F.round(F.col("rmse") + 1e-6, 1).alias("rmse"), "reason_code")


@query("AGG11_ulpin_eligible", f"with {FIT} select page_id, p.polygon_id, coalesce(rmse <= 1.5, false) as eligible from v_polygon p join r on r.page_id = p.polygon_id where p.is_closed and p.polygon_id % 3 = 0")
def agg11(spark, sf):
    from verdigris.functions.geometry import invalid_reason

    p = polygons(spark, sf).select(F.col("polygon_id").alias("page_id"), "polygon_id", invalid_reason(F.col("ring")).alias("invalid"), F.expr("if(polygon_id % 3 = 0, 'bound', 'unbound')").alias("label_status"))
    return A.ulpin_eligible(p, A.fit_affine(view(spark, sf, "v_gcp")))


@query("AGG12_share_sum_validate", """
with s as (select l_orderkey as record_id, l_suppkey % 4 as n, l_suppkey % 5 as d from lineitem),
t as (select record_id, sum(case when d > 0 then n * 12 // d end) as num, bool_or(d = 0) as bad from s group by 1)
select record_id, case when bad then 'SHARE_UNPARSEABLE' when num > 12 then 'SHARE_OVERSUM' when num < 12 then 'SHARE_UNDERSUM' end as reason_code, case when bad or num > 12 then 'fail' else 'pass' end as verdict from t""")
def agg12(spark, sf):
    return A.share_sum_validate(table(spark, sf, "lineitem").selectExpr("l_orderkey as record_id", "l_suppkey % 4 as n", "l_suppkey % 5 as d"))


@query("AGG13_backlog", "select o_orderpriority as queue, count(*) as n, count(*) > 1000 as over_ceiling from orders where o_orderstatus = 'O' group by 1")
def agg13(spark, sf):
    return A.backlog(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("queue"), (F.col("o_orderstatus") != "O").alias("dispatched")), 1000, "queue")


@query("AGG16_prototypes", "with e as (select label, unnest(range(0, 64))::int as pos, unnest(embedding)::double as x from embeddings) select label, pos, round(avg(x), 6) as x, count(*) as n from e group by 1, 2")
def agg16(spark, sf):
    return A.prototypes(table(spark, sf, "embeddings"), "label", "embedding").select("label", "n", F.posexplode("prototype").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("AGG17_audit_agreement", """
with s as (select stratum, case when is_correct then 'agree' when script = 'fr' then 'unsure' else 'disagree' end as verdict from v_label_obs)
select stratum, count_if(verdict in ('agree', 'disagree'))::bigint as n, round(avg(case verdict when 'agree' then 1.0 when 'disagree' then 0.0 end), 6) as rate, count_if(verdict not in ('agree', 'disagree'))::bigint as errors from s group by 1""")
def agg17(spark, sf):
    s = view(spark, sf, "v_label_obs").select("stratum", F.expr("case when is_correct then 'agree' when script = 'fr' then 'unsure' else 'disagree' end").alias("verdict"))
    return A.audit_agreement(s, "stratum")


@query("AGG18_dedup_quality", PASSES + ", g as (select a, b from p group by 1, 2 having count(distinct pass) > 1), t as (select distinct a, b from p where pass = 'survey'), j as (select g.a as ga, t.a as ta from g full join t on g.a = t.a and g.b = t.b) select round(count_if(ga is not null and ta is not null) / nullif(count(ga), 0), 6) as precision, round(count_if(ga is not null and ta is not null) / nullif(count(ta), 0), 6) as recall from j")
def agg18(spark, sf):
    counts = J.pass_counts(J.candidate_blocks(people(spark, sf), passes()))
    return A.counted_quality(counts, F.col("passes").contains(","), F.col("passes").contains("survey"))


@query("AGG19_page_escalation", "select page_id, count_if(coalesce(routing_outcome = 'review', false))::bigint as routed, count_if(coalesce(routing_outcome = 'review', false)) > 1 as escalated from v_extraction group by 1")
def agg19(spark, sf):
    return A.page_escalation(view(spark, sf, "v_extraction"), 1)


@query("AGG20_record_error_policy", "with e as (select page_id as record_id, round(1 - exp(sum(ln(greatest(1e-9, 1 - token_confidence / 10)))) + 1e-9, 5) as error from v_extraction group by 1) select record_id, error, error > 0.2 as review from e")
def agg20(spark, sf):
    return A.record_error_policy(view(spark, sf, "v_extraction").select(F.col("page_id").alias("record_id"), (1 - F.col("token_confidence") / 10).alias("confidence")), 0.2)


@query("AGG21_promotion_gate", f"""
with {ECE}, c as (select stratum, sum(n) as n, sum(n * acc) / sum(n) as accuracy, sum(n * abs(acc - conf)) / sum(n) as ece from b group by 1), l as (select stratum, case when n % 2 = 0 then accuracy - 0.1 else accuracy + 0.05 end as base from c)
select stratum, accuracy < base as regressed, ece > 0.5 as over_ece, round(2.8 * sqrt(case when base < 0 or base > 1 then null else 2 * base * (1 - base) / n end), 6) as detectable, not (accuracy < base or ece > 0.5) as promotable from c join l using (stratum)""")
def agg21(spark, sf):
    e = labelled(spark, sf)
    c = A.ece(e, ["stratum"], "prediction", "is_correct").join(e.groupBy("stratum").agg(F.avg(F.col("is_correct").cast("double")).alias("accuracy")), "stratum")
    base = c.select("stratum", F.expr("if(n % 2 = 0, accuracy - 0.1, accuracy + 0.05)").alias("accuracy"))
    return A.promotion_gate(c, base, 0.5).withColumn("detectable", F.nanvl("detectable", F.lit(None).cast("double")))


@query("AGG22_table_structure", f"with {WORDS}, c as (select page_id, count(distinct floor(x / 120)) as nx, count(distinct floor(y / 80)) as ny from w group by 1) select c.page_id, greatest(1, ny - 1)::int as rows, greatest(1, nx - 1)::int as cols, round(coalesce(round(avg(t.confidence), 4), 1.0) + 1e-6, 2) as confidence from c left join t using (page_id) group by 1, 2, 3")
def agg22(spark, sf):
    w = words(spark, sf)
    cuts = w.groupBy("page_id").agg(F.collect_set(F.floor(F.col("x") / 120)).alias("xs"), F.collect_set(F.floor(F.col("y") / 80)).alias("ys"))
    return A.table_structure(J.assign_tokens_to_cells(w, cells(spark, sf, w)), cuts).withColumn("confidence", F.round(F.col("confidence") + 1e-6, 2))


MERGED = "select l_orderkey as page_id, (l_partkey % 6)::int as row, (l_suppkey % 4)::int as col, (1 + l_suppkey % 3)::int as row_span, (l_partkey % 3)::int as col_span, max('c' || l_partkey) as text from lineitem group by 1, 2, 3, 4, 5"


@query("AGG23_expand_cells", f"""
with m as (select page_id, row, col, max(row_span) as rs, max(col_span) as cs, max(text) as text from ({MERGED}) group by 1, 2, 3),
x as (select page_id, row, col, text, unnest(range(row, least(row + greatest(rs, 1), 5))) as r, cs from m where row < 5 and col < 4),
y as (select page_id, row, col, text, r, unnest(range(col, least(col + greatest(cs, 1), 4))) as c from x),
g as (select page_id, r, c, arg_max(text, (row, col)) as text from y group by 1, 2, 3)
select page_id, string_agg('[R' || r || 'C' || c || '] ' || text, ' ' order by r, c) as text from g group by 1""")
def agg23(spark, sf):
    m = table(spark, sf, "lineitem").selectExpr("l_orderkey as page_id", "cast(l_partkey % 6 as int) as row", "cast(l_suppkey % 4 as int) as col", "cast(1 + l_suppkey % 3 as int) as row_span", "cast(l_partkey % 3 as int) as col_span", "concat('c', l_partkey) as text")
    m = dealt(m, "page_id").groupBy("page_id", "row", "col").agg(F.max("row_span").alias("row_span"), F.max("col_span").alias("col_span"), F.max("text").alias("text"))
    return A.cells_to_tokens(A.expand_cells(m, 5, 4))


@query("WIN14_missing_pages", f"with {COMPLETE} select batch_id as record_id, unnest(gaps)::int as missing from e")
def win14(spark, sf):
    runs = A.missing_pages(positions(spark, sf).select(F.col("batch_id").alias("record_id"), F.col("position").alias("page_index")))
    return runs.select("record_id", F.explode(F.sequence("first", "last")).alias("missing"))
