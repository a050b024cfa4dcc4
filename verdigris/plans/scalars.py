"""Queries of the scalar functions and of scoring."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from verdigris.functions import geometry as G
from verdigris.functions import text as T
from verdigris.operators import aggs as A
from verdigris.operators import plugins as U
from verdigris.operators import scoring as S
from verdigris.plans.joins import polygons
from verdigris.plans.registry import query
from verdigris.plans.views import table, view


@query("SCA1_normalize_text", "select doc_id, case when text <> '' then trim(regexp_replace(text, '\\s+', ' ', 'g')) end as text from documents")
def sca1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query("SCA2_unconstrained_value", "select id, trim(raw_value) as value from v_extraction")
def sca2(spark, sf):
    return view(spark, sf, "v_extraction").select("id", T.unconstrained_value(F.col("raw_value")).alias("value"))


CANON = """
case field_name when 'survey_number' then l_partkey || '/' || l_suppkey when 'khata_number' then l_partkey::varchar
 when 'share_fraction' then (l_suppkey % 4) || '/' || (l_suppkey % 5) when 'area' then l_partkey || '.5 hectare'
 when 'date' then '1987-0' || (1 + l_partkey % 9) || '-0' || (1 + l_suppkey % 9) when 'owner_name' then 'Shri Owner ' || l_suppkey else 'S/o Owner ' || l_suppkey end
"""
LINE = """
l as (select *, case l_linenumber when 1 then 'owner_name' when 2 then 'survey_number' when 3 then 'share_fraction' when 4 then 'area' when 5 then 'khata_number' when 6 then 'relationship' else 'date' end as field_name,
 concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::date) as id from lineitem)
"""


@query("SCA3_canonical_value", f"with {LINE} select id, {CANON} as value from l")
def sca3(spark, sf):
    return view(spark, sf, "v_extraction").select("id", T.canonical_value(F.col("field_name"), F.col("raw_value")).alias("value"))


@query("SCA4_classify_field", f"with {LINE} select id, field_name from l")
def sca4(spark, sf):
    return view(spark, sf, "v_extraction").select("id", T.classify_field(F.col("raw_value"), F.lit("ror")).alias("field_name"))


@query("SCA5_extract_fields", f"with {LINE} select id, field_name, v.raw_value, {CANON} as canonical_value, trim(v.raw_value) as unconstrained_value, 'unknown' as entry_status from l join v_extraction v using (id, field_name)")
def sca5(spark, sf):
    t = view(spark, sf, "v_extraction").select("id", F.col("raw_value").alias("text"), F.lit("ror").alias("doc_type"))
    blank = t.select("id", F.lit("  ").alias("text"), "doc_type")
    return S.extract_fields(t.unionByName(blank)).select("id", "field_name", "raw_value", "canonical_value", "unconstrained_value", "entry_status")


@query("SCA6_parse_fraction", f"with {LINE} select id, case when field_name = 'survey_number' and l_suppkey > 0 then l_partkey when field_name = 'share_fraction' and l_suppkey % 5 > 0 then l_suppkey % 4 when field_name = 'date' then 1 + l_suppkey % 9 end::bigint as n, case when field_name = 'survey_number' and l_suppkey > 0 then l_suppkey when field_name = 'share_fraction' and l_suppkey % 5 > 0 then l_suppkey % 5 when field_name = 'date' then 1 + l_partkey % 9 end::bigint as d from l")
def sca6(spark, sf):
    f = T.parse_fraction(F.col("raw_value"))
    return view(spark, sf, "v_extraction").select("id", f["n"].alias("n"), f["d"].alias("d"))


@query("SCA7_edit_distance", "select c_custkey, levenshtein(c_name, c_mktsegment)::int as distance from customer")
def sca7(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.edit_distance(F.col("c_name"), F.col("c_mktsegment")).alias("distance"))


@query("SCA8_page_digest", "select doc_id, sha256(text) as digest from documents")
def sca8(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("sha256/xx/"), F.sha2("text", 256)).alias("uri"))
    return d.select("doc_id", T.page_digest(F.col("uri")).alias("digest"))


@query("SCA9_stratum_key", "select id, field_name || '|' || script || '||' || legibility_band || '|' || writer_cluster_id as key, field_name || '|' || script || '|printed|' || legibility_band as canonical from v_extraction")
def sca9(spark, sf):
    c = F.col
    return view(spark, sf, "v_extraction").select("id", T.stratum_key(c("field_name"), c("script"), F.lit(None).cast("string"), c("legibility_band"), c("writer_cluster_id")).alias("key"), T.canonical_stratum(c("field_name"), c("script"), F.lit(" "), c("legibility_band")).alias("canonical"))


@query("SCA10_engine_kind", "select id, case engine when 'hwr' then 'handwritten' else 'printed' end as kind from v_extraction")
def sca10(spark, sf):
    return view(spark, sf, "v_extraction").select("id", T.engine_kind(F.col("engine")).alias("kind"))


@query("SCA13_affine_apply", "select page_id, pixel_x, pixel_y, round(2 * pixel_x + 0.5 * pixel_y + 500000, 4) as gx, round(0.25 * pixel_x - 1.5 * pixel_y + 3000000, 4) as gy from v_gcp")
def sca13(spark, sf):
    m = F.struct(*[F.lit(v).alias(k) for k, v in zip("abcdef", (2.0, 0.5, 500000.0, 0.25, -1.5, 3000000.0), strict=True)])
    x, y = G.affine(F.col("pixel_x"), F.col("pixel_y"), m)
    return view(spark, sf, "v_gcp").select("page_id", "pixel_x", "pixel_y", x.alias("gx"), y.alias("gy"))


@query("SCA14_rotate_to_original", "select page_id, token_id, x, y, round(cos(radians(3.0)) * (x - 400) - sin(radians(3.0)) * (y - 300) + 400, 4) as ox, round(sin(radians(3.0)) * (x - 400) + cos(radians(3.0)) * (y - 300) + 300, 4) as oy from v_token")
def sca14(spark, sf):
    x, y = G.rotate_back(F.col("x"), F.col("y"), F.lit(3.0), F.lit(800.0), F.lit(600.0))
    return view(spark, sf, "v_token").select("page_id", "token_id", "x", "y", F.round(x, 4).alias("ox"), F.round(y, 4).alias("oy"))


def bent(spark, sf):
    """The polygons; every seventh has two corners changed over and so crosses itself."""
    r = F.col("ring")
    twisted = F.array(F.get(r, 0), F.get(r, 2), F.get(r, 1), F.get(r, 3), F.get(r, 0))
    return polygons(spark, sf).withColumn("ring", F.when((F.col("polygon_id") % 7 == 0) & F.col("is_closed"), twisted).otherwise(r))


VALID = "case when not is_closed then 'not_closed' when polygon_id % 7 = 0 then 'self_intersecting' end"


@query("SCA15_polygon_valid", f"select polygon_id, {VALID} as reason from v_polygon")
def sca15(spark, sf):
    return bent(spark, sf).select("polygon_id", G.invalid_reason(F.col("ring")).alias("reason"))


@query("SCA16_polygon_area", f"select polygon_id, case when ({VALID}) is not null then '0.00' else (side * side)::decimal(38, 2)::varchar end as area from v_polygon where crs = 'EPSG:32643'")
def sca16(spark, sf):
    p = bent(spark, sf).filter("crs = 'EPSG:32643'")
    return p.select("polygon_id", G.polygon_area(F.col("ring"), F.col("crs")).alias("area"))


@query("SCA16_geographic_area", """
with p as (select polygon_id, x0 / 1000 as x0, y0 / 1000 as y0, side / 1000 as s from v_polygon where crs = 'EPSG:4326' and is_closed)
select polygon_id, round(radians(s) * radians(s) * abs(cos(radians(y0 + s * 2 / 5))) * 6371008.8 * 6371008.8 / 1000, 0) as kilo from p""")
def sca16b(spark, sf):
    p = polygons(spark, sf).filter("crs = 'EPSG:4326' and is_closed")
    small = F.transform("ring", lambda q: F.struct((q["x"] / 1000).alias("x"), (q["y"] / 1000).alias("y")))
    return p.select("polygon_id", F.round(G.ring_area(G.to_metres(small)) / 1000, 0).alias("kilo"))


@query("WIN11_clean_vertices", "select polygon_id, case when is_closed then 5 else 4 end as n from v_polygon")
def win11(spark, sf):
    near = F.flatten(F.transform("ring", lambda p: F.array(p, F.struct((p["x"] + 0.0001).alias("x"), p["y"].alias("y")))))
    return polygons(spark, sf).select("polygon_id", F.size(G.clean_vertices(near)).alias("n"))


@query("SCA17_vectorize", f"select polygon_id, {VALID} as reason, ({VALID}) is not null as broken from v_polygon")
def sca17(spark, sf):
    return vectorize(bent(spark, sf), F.struct(*[F.lit(v).alias(k) for k, v in zip("abcdef", (2.0, 0.0, 10.0, 0.0, 2.0, 20.0), strict=True)])).select("polygon_id", "reason", "broken")


def vectorize(polygons_, m):
    """Clean and transform rings and validate them; broken ones are kept with their reason, never repaired."""
    moved = F.transform(G.clean_vertices(F.col("ring")), lambda p: F.struct(*[c.alias(n) for c, n in zip(G.affine(p["x"], p["y"], m), "xy", strict=True)]))
    d = polygons_.withColumn("ring", moved)
    return d.withColumn("reason", G.invalid_reason(F.col("ring"))).withColumn("broken", F.col("reason").isNotNull())


def scored(spark, sf):
    """Labelled observations with the columns that features need."""
    o = view(spark, sf, "v_label_obs")
    return o.select("extraction_id", "stratum", "script", "field_class", F.col("prediction").alias("token_confidence"), F.when(F.col("extraction_id") % 2 == 0, F.col("prediction") / 2).alias("layout_certainty"), F.lit(None).cast("double").alias("normalization_confidence"), F.expr("if(extraction_id % 3 = 0, array('pass', 'fail'), array())").alias("outcomes"), F.expr("elt(extraction_id % 3 + 1, 'good', 'marginal', 'poor')").alias("legibility_band"), F.expr("if(extraction_id % 4 = 0, 'handwritten', 'printed')").alias("print_or_handwriting"), F.lit("ror").alias("doc_type"), "is_correct")


NUMBERS = """
n as (select extraction_id, stratum, script, field_class, is_correct, prediction as f0, case when extraction_id % 2 = 0 then prediction / 2 else 0.5 end as f2, (extraction_id % 2 <> 0)::int::double as f3,
 case when extraction_id % 3 = 0 then 0.5 else 1.0 end::double as f6, (extraction_id % 3 <> 0)::int::double as f7, [1.0, 0.5, 0.0][extraction_id % 3 + 1]::double as f8, (extraction_id % 4 = 0)::int::double as f9 from v_label_obs),
x as (select extraction_id, stratum, script, field_class, is_correct, f0, [f0, 0, f2, f3, 0.5, 1, f6, f7, f8, f9]::double[] as x from n)
"""


@query("SCA18_encode_features", f"""
with {NUMBERS}, s as (select list_sort(list(distinct field_class)) as f, list_sort(list(distinct script)) as p from x)
select extraction_id, array_to_string(list_transform(list_concat(list_concat(list_concat(x, list_transform(f, lambda v: (v = field_class)::int::double)), list_transform(p, lambda v: (v = script)::int::double)), [1.0::double]), lambda v: round(v * 1000)::int), ',') as x from x, s""")
def sca18(spark, sf):
    d = scored(spark, sf)
    e = S.encode_features(d, S.categories_of(d))
    return e.select("extraction_id", F.array_join(F.transform("x", lambda v: F.round(v * 1000).cast("int").cast("string")), ",").alias("x"))


PROTO = """
e as (select label, unnest(range(0, 64))::int as pos, unnest(embedding)::double as v from embeddings where label < 8), p as (select label, pos, avg(v) as m from e group by 1, 2),
u as (select vec_id, label, unnest(range(0, 64))::int as pos, unnest(embedding)::double as v from embeddings),
d as (select vec_id, u.label, sqrt(sum(pow(v - m, 2))) / 8 as dist from u left join p on p.label = u.label and p.pos = u.pos group by 1, 2)
"""


def novel(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("label", "stratum")
    return S.novelty(e, A.prototypes(e.filter("stratum < 8"), "stratum", "embedding"), limit=0.12)


@query("SCA19_novelty_score", f"with {PROTO} select vec_id, round(coalesce(least(1, dist), 1), 5) as novelty_score, dist is null or dist > 0.12 as outside, case when dist is null then 'unseen_stratum' when dist > 0.12 then 'distance_over_limit' end as reason_code from d")
def sca19(spark, sf):
    return novel(spark, sf).select("vec_id", F.round("novelty_score", 5).alias("novelty_score"), "outside", "reason_code")


ROUTE = """
case when l_partkey % 11 = 0 then 'outside_calibrated_regime' when l_partkey % 7 = 0 then 'conflict' when round(l_discount * 10, 2)::double / 10 < 1 - 0.97::double then 'review'
 when l_suppkey % 3 <> 0 then 'review' when l_partkey % 5 = 0 then 'audit_sample' else 'auto_accept' end
"""


@query("SCA20_route_fields", f"with {LINE} select id, {ROUTE} as outcome from l")
def sca20(spark, sf):
    e = table(spark, sf, "lineitem").selectExpr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as date)) as id", "round(l_discount * 10, 2) / 10 as confidence", "l_partkey % 11 = 0 as outside", "l_partkey % 7 = 0 as conflict", "elt(l_suppkey % 3 + 1, 'steady', 'ramp', 'shadow') as state", "l_partkey % 5 = 0 as sampled")
    return S.route_fields(e, 0.97).select("id", "outcome")


WEIGHTS = [1.0, -0.5, 0.8, -0.2, 0.0, 0.1, 0.4, -0.1, 0.6, -0.7]


def models(spark):
    return spark.createDataFrame([("en|src1", [w * 2 for w in WEIGHTS], 0.25)], "stratum string, w array<double>, b double")


Z = " + ".join(f"{w} * x[{i + 1}]" for i, w in enumerate(WEIGHTS))


@query("SCA21_apply_calibrator", f"with {NUMBERS} select extraction_id, round(case when stratum = 'en|src1' then 1 / (1 + exp(-(2 * ({Z}) + 0.25))) else 1 / (1 + exp(-({Z} - 0.1))) end, 6) as confidence, case when stratum = 'en|src1' then 'stratum_specific' else 'pooled_fallback' end as regime from x")
def sca21(spark, sf):
    d = S.apply_calibrator(S.numeric_features(scored(spark, sf)), models(spark), WEIGHTS, -0.1)
    return d.select("extraction_id", F.round("confidence", 6).alias("confidence"), "regime")


@query("SCA22_syntactic_validate", f"with {LINE} select id, case when field_name in ('owner_name', 'relationship') then 'not_applicable' when field_name = 'share_fraction' and l_suppkey % 5 = 0 then 'fail' else 'pass' end as verdict, case when field_name = 'share_fraction' and l_suppkey % 5 = 0 then 'FORMAT_SHARE_FRACTION' end as reason_code from l")
def sca22(spark, sf):
    e = view(spark, sf, "v_extraction").withColumn("canonical_value", T.canonical_value(F.col("field_name"), F.col("raw_value")))
    return S.syntactic_validate(e).select("id", "verdict", "reason_code")


@query("SCA23_geospatial_validate", """
select polygon_id as id, case when polygon_id % 25 % 2 <> 0 then 'UNIT_TABLE_UNVERIFIED' when polygon_id % 4 = 0 then 'AREA_DISAGREES' end as reason_code,
 case when polygon_id % 25 % 2 <> 0 then 'not_applicable' when polygon_id % 4 = 0 then 'fail' else 'pass' end as verdict from v_polygon""")
def sca23(spark, sf):
    n = table(spark, sf, "nation").selectExpr("n_nationkey", "n_name as district")
    units = n.filter("n_nationkey % 2 = 0").select("district", F.lit(1008.0).alias("m2"))
    p = view(spark, sf, "v_polygon").withColumn("n_nationkey", F.col("polygon_id") % 25).join(n, "n_nationkey")
    area = F.col("side") * F.col("side")
    p = p.select(F.col("polygon_id").alias("id"), "district", (area / 1008 * F.when(F.col("polygon_id") % 4 == 0, 1.2).otherwise(1.01)).alias("recorded"), area.alias("area_m2"))
    return S.geospatial_validate(p, units, 0.05)


@query("UDF1_register_calibrator", f"with {NUMBERS} select extraction_id, round(0.5 * f0 + 0.25, 6) as probability, round(0.5 * f0, 6) as token from x")
def udf1(spark, sf):
    def fn(f: pd.DataFrame) -> pd.DataFrame:
        t = f["token_confidence"].fillna(0.5) * 0.5
        return pd.DataFrame({"probability": t + 0.25, "attributions": [{"token": float(v)} for v in t]})

    d = U.apply_calibrator(scored(spark, sf).select("extraction_id", "token_confidence"), fn, ["token_confidence"])
    return d.select("extraction_id", F.round("probability", 6).alias("probability"), F.round(d["attributions"]["token"], 6).alias("token"))


@query("UDF2_register_novelty", "select vec_id, round(abs(embedding[1]::double), 5) as score, abs(embedding[1]) > 0.2 as outside, 'doc:' || label as cluster from embeddings")
def udf2(spark, sf):
    def fn(f: pd.DataFrame) -> pd.DataFrame:
        s = f["embedding"].map(lambda v: abs(float(v[0])))
        return pd.DataFrame({"score": s, "outside": s > 0.2, "reason": None, "cluster": "doc:" + f["label"].astype(str)})

    return U.apply_novelty(table(spark, sf, "embeddings"), fn, ["embedding", "label"]).select("vec_id", F.round("score", 5).alias("score"), "outside", "cluster")


@query("UDF5_register_extractor", """
with w as (select page_id, list_filter(string_split_regex(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\p{Z}]+'), lambda x: x <> '') as w from pages)
select page_id, unnest(range(0, len(w))) as position, unnest(w) as text, 1.0::double as confidence from w""")
def udf5(spark, sf):
    import re

    strip = re.compile(r"<[^>]*>")

    def reader(html: str) -> list[tuple[str, float]]:
        return [(w, 1.0) for w in strip.sub(" ", html).split()]

    return U.extract_with(table(spark, sf, "pages"), reader, "html", "page_id")


GRADIENT = ", ".join(f"w[{j}] - 0.5 * (sum((p - y) * x[{j}]) / count(*) + 0.01 * w[{j}])" for j in range(1, 11))


@query("JOB8_train_calibrators", f"""
with recursive {NUMBERS}, o as (select stratum, x, is_correct::int::double as y from x where is_correct is not null),
r as (select stratum, x, y from o where stratum in (select stratum from o group by 1 having count(*) >= 5) union all select '*', x, y from o),
t as (select stratum, 0 as step, list_transform(range(10), lambda v: 0.0::double) as w, 0.0::double as b from (select distinct stratum from r)
 union all select stratum, step + 1, [{GRADIENT}], b - 0.5 * sum(p - y) / count(*)
 from (select t.stratum, t.step, t.w, t.b, r.x, r.y, 1 / (1 + exp(-greatest(-50, least(50, list_inner_product(t.w, r.x) + t.b)))) as p from t join r on r.stratum = t.stratum where t.step < 150) group by stratum, step, w, b)
select stratum, round(b, 6) as b, array_to_string(list_transform(w, lambda v: round(v * 1000000)::bigint), ',') as w from t where step = 150""")
def job8(spark, sf):
    d = S.numeric_features(scored(spark, sf)).filter("is_correct IS NOT NULL").select("stratum", "x", F.col("is_correct").cast("double").alias("y"))
    return S.train_calibrators(d, 5).select("stratum", F.round("b", 6).alias("b"), F.array_join(F.transform("w", lambda v: F.round(v * 1_000_000).cast("long").cast("string")), ",").alias("w"))


@query("JOB9_score_fields", f"""
with {NUMBERS}, {PROTO}, f as (select x.*, d.dist, vec_id from x join d on d.vec_id = x.extraction_id),
c as (select *, case when dist is null or dist > 0.12 then true else false end as outside, 1 / (1 + exp(-({Z} - 0.1))) as confidence from f)
select extraction_id, round(confidence, 6) as confidence, case when vec_id % 10 = 0 then 'missing_pinned_version' end as reason_code,
 case when vec_id % 10 = 0 then null when outside then 'outside_calibrated_regime' when vec_id % 7 = 0 then 'conflict' when confidence < 1 - 0.3 then 'review' when vec_id % 5 = 0 then 'audit_sample' else 'auto_accept' end as outcome from c""")
def job9(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("extraction_id"), "embedding", F.col("label").alias("cluster"))
    f = S.numeric_features(scored(spark, sf)).drop("stratum").join(e, "extraction_id").withColumnRenamed("cluster", "stratum")
    pins = F.when(F.col("extraction_id") % 10 == 0, F.create_map(F.lit("novelty"), F.lit("1"))).otherwise(F.create_map(F.lit("novelty"), F.lit("1"), F.lit("calibrator"), F.lit("2")))
    f = f.withColumn("pins", pins).withColumn("conflict", F.col("extraction_id") % 7 == 0).withColumn("state", F.lit("steady")).withColumn("sampled", F.col("extraction_id") % 5 == 0)
    proto = A.prototypes(table(spark, sf, "embeddings").filter("label < 8").withColumnRenamed("label", "stratum"), "stratum", "embedding")
    none = spark.createDataFrame([], "stratum int, w array<double>, b double")
    return S.score_fields(f, proto, none, WEIGHTS, 0.3, -0.1, 0.12).select("extraction_id", F.round("confidence", 6).alias("confidence"), "reason_code", "outcome")
