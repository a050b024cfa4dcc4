"""Business views over the driver's tables; the same text runs in Spark SQL and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "v_batch": """
select o.o_orderkey as document_id, n.n_nationkey as batch_id,
       case when n.n_nationkey % 10 = 9 then '  ' else n.n_name end as district,
       case o.o_orderkey % 5 when 0 then 'application/pdf' when 1 then 'image/tiff'
            when 2 then 'image/png' when 3 then 'image/jpeg' else 'text/plain' end as mime,
       o.o_orderdate as received_at
from orders o join customer c on o.o_custkey = c.c_custkey
join nation n on c.c_nationkey = n.n_nationkey
""",
    "v_page": """
select o_orderkey as page_id, o_custkey as document_id,
       case o_orderkey % 8 when 0 then 'ror' when 1 then 'jamabandi' when 2 then 'khasra_khatauni'
            when 3 then 'mutation_register' when 4 then 'deed' when 5 then 'cadastral_map'
            when 6 then 'fmb_sketch' else 'unknown' end as doc_type,
       case o_orderkey % 5 when 0 then 'text' when 1 then 'tabular_register' when 2 then 'map_sheet'
            when 3 then 'endorsement' else 'blank' end as page_role,
       o_orderdate as at
from orders
""",
    "v_extraction": """
select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string),
                 cast(l_suppkey as string), cast(cast(l_shipdate as date) as string)) as id,
       l_orderkey as page_id, l_linenumber as index_position,
       case l_linenumber when 1 then 'owner_name' when 2 then 'survey_number' when 3 then 'share_fraction'
            when 4 then 'area' when 5 then 'khata_number' when 6 then 'relationship' else 'date' end as field_name,
       case l_linenumber when 1 then concat(' Shri   Owner ', cast(l_suppkey as string))
            when 2 then concat('Khasra No. ', cast(l_partkey as string), '/', cast(l_suppkey as string))
            when 3 then concat('hissa ', cast(l_suppkey % 4 as string), '/', cast(l_suppkey % 5 as string))
            when 4 then concat(cast(l_partkey as string), '.5 Hectare')
            when 5 then concat('khata no ', cast(l_partkey as string))
            when 6 then concat('S/o Owner ', cast(l_suppkey as string))
            else concat('dated 0', cast(1 + l_suppkey % 9 as string), '/0', cast(1 + l_partkey % 9 as string), '/1987') end as raw_value,
       round(l_discount * 10, 2) as token_confidence,
       case when l_linestatus = 'F' then 'hwr' else 'printed_ocr' end as engine,
       case when l_quantity >= 34 then 'good' when l_quantity >= 17 then 'marginal' else 'poor' end as legibility_band,
       l_returnflag as script, concat('w', cast(l_suppkey % 5 as string)) as writer_cluster_id,
       case l_partkey % 7 when 0 then 'auto_accept' when 1 then 'audit_sample' when 2 then 'review'
            when 3 then 'conflict' when 4 then 'outside_calibrated_regime' when 5 then null else 'bogus' end as routing_outcome,
       case l_suppkey % 6 when 0 then 'live' when 1 then 'cancelled' when 2 then 'superseded'
            when 3 then 'amended' else 'unknown' end as entry_status
from lineitem
""",
    "v_validation": """
select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string),
                 cast(l_suppkey as string), cast(cast(l_shipdate as date) as string)) as extraction_id,
       l_orderkey as record_id,
       case l_suppkey % 3 when 0 then 'syntactic' when 1 then 'arithmetic' else 'referential' end as validator,
       case l_partkey % 3 when 0 then 'pass' when 1 then 'fail' else 'not_applicable' end as verdict,
       case when l_suppkey % 4 = 0 then 'gazetteer' else null end as consumed_constraint
from lineitem
""",
    "v_audit": """
select event_id as id, ts as at, concat('u', cast(user_id as string)) as actor,
       case event_type when 'view' then 'page.ingested' when 'click' then 'page.processed'
            when 'purchase' then 'record.published' else concat('other.', event_type) end as action,
       cast(event_id as string) as subject, concat('district', cast(user_id % 7 as string)) as district
from events
""",
    "v_config": """
select event_id as id, case when user_id % 2 = 0 then 'district' else 'global' end as scope,
       concat('k', cast(user_id % 11 as string)) as key, value as value, ts as effective_from,
       concat('a', cast(user_id % 3 as string)) as author, concat('a', cast(event_id % 3 as string)) as approver
from events where event_type = 'purchase'
""",
    "v_correction": """
select l.l_orderkey as page_id, l.l_partkey as part_id, l.l_shipdate as created_at,
       case l.l_linenumber when 1 then 'owner_name' when 2 then 'survey_number' when 3 then 'share_fraction'
            else 'text_line' end as field_class,
       p.p_name as predicted,
       case l.l_suppkey % 3 when 0 then p.p_name when 1 then concat(p.p_name, 's') else p.p_type end as corrected,
       concat('u', cast(l.l_suppkey as string)) as actor
from lineitem l join part p on l.l_partkey = p.p_partkey
""",
    "v_task": """
select o_orderkey as id, o_orderdate as opened_at,
       case when o_orderkey % 10 = 0 then 'audit' else 'routed' end as source_stream,
       case when o_orderstatus = 'O' then null else concat('u', cast(o_custkey % 9 as string)) end as assignee,
       case when o_orderstatus = 'F' then o_orderdate else null end as closed_at
from orders
""",
    "v_conflict": """
select o_orderkey as id, o_orderkey as record_id, concat('rule', cast(o_orderkey % 3 as string)) as rule,
       case o_orderkey % 4 when 0 then 'open' when 1 then 'under_enquiry' when 2 then 'resolved' else 'referred' end as state,
       o_orderdate as opened_at
from orders where o_orderkey % 20 < 4
""",
    "v_token": """
select l_orderkey as page_id, l_partkey as token_id,
       case l_suppkey % 4 when 0 then 'survey_number' when 1 then 'owner_name' when 2 then 'share_fraction'
            else 'relationship' end as field_name,
       cast((l_partkey % 10) * 60 as double) as x, cast((l_linenumber - 1) * 40 + l_suppkey % 10 as double) as y,
       l_quantity as w, cast(20 as double) as h, round(l_discount * 10, 2) as confidence
from lineitem
""",
    "v_stroke": """
select l_orderkey as page_id, cast((l_partkey % 10) * 60 as double) as x1,
       cast((l_linenumber - 1) * 40 + 12 as double) as y1,
       cast((l_partkey % 10) * 60 + 80 as double) as x2, cast((l_linenumber - 1) * 40 + 14 as double) as y2
from lineitem where l_suppkey % 7 = 0
""",
    "v_polygon": """
select p_partkey as polygon_id, cast((p_partkey % 40) * 60 as double) as x0,
       cast(floor(p_partkey / 40.0) * 60 as double) as y0, cast(p_size as double) as side,
       case when p_partkey % 2 = 0 then 'EPSG:32643' else 'EPSG:4326' end as crs,
       p_partkey % 11 <> 0 as is_closed
from part
""",
    "v_label": """
select l_orderkey as label_id, concat('S', cast(l_partkey as string)) as text,
       cast((l_partkey % 40) * 60 + l_quantity as double) as x,
       cast(floor(l_partkey / 40.0) * 60 + l_linenumber as double) as y
from lineitem where l_linenumber <= 2
""",
    "v_gcp": """
select l_orderkey as page_id, l_quantity as pixel_x, cast(l_linenumber * 100 + l_partkey % 13 as double) as pixel_y,
       cast(500000 + 2 * l_quantity + (l_linenumber * 100 + l_partkey % 13) * 0.5 + (l_suppkey % 3) * 0.25 as double) as geo_x,
       cast(3000000 - (l_linenumber * 100 + l_partkey % 13) * 1.5 + (l_suppkey % 2) * 0.25 as double) as geo_y
from lineitem
""",
    "v_label_obs": """
select d.doc_id as extraction_id, concat(d.lang, '|', d.source) as stratum, d.lang as script, d.source as field_class,
       cast(d.doc_id % 100 as double) / cast(100 as double) as prediction, l.quality = 1 as is_correct, d.text as page_text
from documents d join labels l on d.doc_id = l.doc_id
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; its tables are read where they are named."""
    return spark.sql(re.sub(r"\b(from|join) (\w+)", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", VIEWS[name]))


def with_views(sql: str) -> str:
    """Put the views that a query names before it."""
    used = [f"{k} as ({VIEWS[k]})" for k in VIEWS if re.search(rf"\b{k}\b", sql)]
    if not used:
        return sql
    head = "with recursive " if re.search(r"\brecursive\b", sql) else "with "
    body = sql.strip()
    if body.lower().startswith("with "):
        rest = re.sub(r"^with\s+(recursive\s+)?", "", body, flags=re.I)
        return head + ", ".join(used) + ", " + rest
    return head + ", ".join(used) + " " + body
