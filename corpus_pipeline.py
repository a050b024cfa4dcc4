"""From raw documents to token ids in five stages, each one operator of `verdigris.llm`.

Every stage takes any rows that have the columns of `documents`, with nulls, empty
and very long texts, ties and repeated rows, and keeps extra columns, whatever their
names, up to the last one, which returns doc_id, lang, source, token_ids and n_tokens.
- quality rules: a null or empty text has no words and goes; repeated rows are judged alike.
- near dedup: of a group the smallest doc_id stays (null last), of repeated rows one;
  texts without words form one group.
- personal data: a null text stays null; every other text keeps its place and row.
- source mix: a row without words is taken no time; rows that repeat share their copies.
- token ids: a null text counts as empty.
Empty tables pass through as empty tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import bpe, mixing, pii, quality, simhash
from verdigris.llm.common import freeing, shared_dir, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles)."""
    return simhash.deduplicated(docs, shingle=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, token_ids, n_tokens."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), VOCABULARY, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: Several stages cannot be said in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{k}"
        kept = stage(spark, docs, sf_dir)
        with freeing(spark):
            kept.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
