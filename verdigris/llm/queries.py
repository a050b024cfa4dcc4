"""The queries op1 to op13: each applies its operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import alignment, ann, audit, bpe, html, mixing, pii, quality, records, secrets, sharding, simhash, warc
from verdigris.llm.common import shared_dir, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter("vec_id % 20 = 0"), 20)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.archive(table(spark, sf_dir, "pages"), path)
    return warc.summary(spark, path)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.joined(F.col("base_spans")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(mixing.sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.quality(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count("base_spans", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base_spans"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op11_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    records.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    return records.load(spark, path).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = audit.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit.interactions(counted)


QUERIES = {f.__name__: f for f in (op1_nearest_neighbours, op2_byte_bpe, op3_main_text, op4_warc, op5_simhash, op6_sharding, op7_secrets, op8_mixing, op9_quality, op10_pii, op11_token_records, op12_alignment, op13_filter_audit)}

ORACLE = {
    "op4_warc": """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), r as (
  select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as first from p
)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
       case when page_id < first then 'revisit' else 'response' end as record_type,
       case when page_id < first then first end as refers_to
from r
""",
    "op13_filter_audit": r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents
), f as (
  select part, doc_id,
         case when len(words) < 100 then 1 else 0 end
         + case when 100 * len(list_distinct(words)) < 80 * len(words) then 2 else 0 end
         + case when 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) then 4 else 0 end
         + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
         + case when doc_id > min(doc_id) over (partition by text) then 16 else 0 end as code
  from d
), l as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), c as (
  select part, code, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join l using (doc_id) group by part, code
), bits as (
  select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as t(name, bit)
), orders as (
  select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bit
  from bits a, bits b, bits c, bits d, bits e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps as (
  select filter_order, s.step, bit[s.step] as own, list_sum(bit[1:s.step]) as done, list_sum(bit[1:s.step]) - bit[s.step] as earlier
  from orders, (select unnest([1, 2, 3, 4, 5])::int as step) s
), r as (
  select part, filter_order, step, own,
         sum(case when code & done::int = 0 then n else 0 end) as kept,
         sum(case when code & earlier::int = 0 and code & own <> 0 then n else 0 end) as removed,
         sum(case when code & earlier::int <> 0 and code & own <> 0 then n else 0 end) as redundant,
         sum(case when code = own then n else 0 end) as unique_fails,
         sum(case when code & earlier::int = 0 and code & own <> 0 then good else 0 end) as good_lost,
         sum(case when code & earlier::int = 0 and code & own <> 0 then toxic else 0 end) as toxic_lost
  from steps, c group by part, filter_order, step, own
)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
       good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley
from r
""",
}
