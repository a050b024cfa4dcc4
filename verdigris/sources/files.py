"""Batches of files: acceptance, content digests, deduplication, fixity, sinks, queue rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values.
MIMES = ("application/pdf", "image/jpeg", "image/png", "image/tiff")
BY_SUFFIX = {"pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff"}
ENVELOPE_KEYS = ("emitted_at", "message_id", "payload", "producer", "trace_id")


def reject_reason(district: Column, mime: Column) -> Column:
    """Reason code of a refused file, null if it is accepted."""
    return F.when(district.isNull() | (F.trim(district) == ""), "missing_mandatory_field:district").when(~F.coalesce(mime.isin(*MIMES), F.lit(False)), "unsupported_mime_type")


def accept_batches(df: DataFrame) -> DataFrame:
    """Add reason_code to rows with district and mime."""
    return df.withColumn("reason_code", reject_reason(F.col("district"), F.col("mime")))


def put_files(files: DataFrame, path: str) -> None:
    """Write rows (name, content) as files of a drop folder, dealt by name over the tasks; a repeated task writes the same files again."""

    def put(rows: Iterator[Row]) -> None:
        store, root = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
        store.create_dir(root, recursive=True)
        for r in rows:
            with store.open_output_stream(f"{root}/{r['name']}") as f:
                f.write(r["content"].encode())

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files.select("name", "content").repartition(tasks, "name").foreachPartition(put)


def scan_batch_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a drop folder with their `.meta.json` sidecars: path, content, district, mime, reason_code.

    A sidecar that is missing or no JSON object gives its own reason code; the
    mime type comes from the sidecar, else from the file's suffix.
    """
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    side = found.filter(F.col("path").endswith(".meta.json")).select(F.regexp_replace("path", r"\.meta\.json$", "").alias("path"), F.decode("content", "UTF-8").alias("meta"))
    files = found.filter(~F.col("path").endswith(".meta.json")).join(side, "path", "left")
    meta = F.try_parse_json("meta")
    files = files.withColumn("_ok", F.schema_of_variant(meta).startswith("OBJECT")).withColumn("_meta", F.from_json("meta", "district string, mime string"))
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    guessed = F.coalesce(F.create_map(*[F.lit(x) for kv in BY_SUFFIX.items() for x in kv])[suffix], F.lit("application/octet-stream"))
    files = files.withColumn("district", F.col("_meta.district")).withColumn("mime", F.coalesce("_meta.mime", guessed))
    reason = F.when(F.col("meta").isNull(), "missing_batch_metadata").when(~F.coalesce("_ok", F.lit(False)), "invalid_batch_metadata").otherwise(reject_reason(F.col("district"), F.col("mime")))
    return files.select("path", "content", "district", "mime", reason.alias("reason_code"))


def content_digest(df: DataFrame, col: str) -> DataFrame:
    """Add sha256 and the storage key sha256/ab/cd/abcd..."""
    d = F.sha2(F.coalesce(F.col(col), F.lit("")), 256)
    return df.withColumn("sha256", d).withColumn("storage_key", F.concat_ws("/", F.lit("sha256"), F.substring("sha256", 1, 2), F.substring("sha256", 3, 2), F.col("sha256")))


def dedupe_ingest(new: DataFrame, existing: DataFrame, order: str = "doc_id") -> DataFrame:
    """First row of each digest is stored unless `existing` (sha256, document_id) has it; others resolve to it."""
    first = new.groupBy("sha256").agg(F.min(order).alias("_first"))
    known = existing.groupBy("sha256").agg(F.min("document_id").alias("_known"))
    d = new.join(first, "sha256").join(known, "sha256", "left")
    return d.select(order, "sha256", F.coalesce("_known", "_first").alias("document_id"), (F.col("_known").isNull() & (F.col(order) == F.col("_first"))).alias("created"))


def get_or_create_batch(requests: DataFrame, batches: DataFrame) -> DataFrame:
    """Each requested batch (batch_id, district): reused or created; a blank district is refused either way."""
    known = batches.select("batch_id", F.lit(True).alias("_known")).distinct()
    one = requests.groupBy("batch_id").agg(F.min("district").alias("district")).join(known, "batch_id", "left")
    bad = F.col("district").isNull() | (F.trim("district") == "")
    return one.select("batch_id", "district", F.when(bad, "missing_mandatory_field:district").alias("reason_code"), F.when(bad, "refused").when(F.col("_known"), "reused").otherwise("created").alias("outcome"))


def split_document(docs: DataFrame, done: DataFrame, sep: str = "\n") -> DataFrame:
    """Units of each text not yet split: doc_id, index from 0, unit, page_count."""
    fresh = docs.join(done.select("doc_id"), "doc_id", "left_anti").filter(F.col("text").isNotNull())
    parts = fresh.select("doc_id", F.split("text", sep).alias("parts"))
    return parts.select("doc_id", F.size("parts").alias("page_count"), F.posexplode("parts").alias("index", "unit"))


def fixity_sweep(manifest: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """One check row a document and store; `manifest` (doc_id, sha256), stores (doc_id, content)."""
    both = primary.select("doc_id", "content", F.lit("primary").alias("store")).unionByName(secondary.select("doc_id", "content", F.lit("secondary").alias("store")))
    checked = manifest.join(both, "doc_id")
    return checked.select("doc_id", "store", F.when(F.sha2(F.coalesce("content", F.lit("")), 256) == F.col("sha256"), "match").otherwise("mismatch").alias("outcome"))


def self_fixity(files: DataFrame) -> DataFrame:
    """A content's digest must be the last part of its own key (path, content)."""
    return files.withColumn("ok", F.sha2(F.coalesce("content", F.lit("")), 256) == F.substring_index("path", "/", -1))


def publish_receipts(records: DataFrame, order: str, target: str) -> DataFrame:
    """Receipt rows: a running reference for each target."""
    n = F.row_number().over(W.partitionBy(target).orderBy(order))
    return records.select(order, target, F.lit(True).alias("accepted"), F.concat_ws("-", F.col(target), n.cast("string")).alias("reference"))


def publish_sink(records: DataFrame, path: str, order: str, target: str) -> DataFrame:
    """Write the records partitioned by target and return the receipts."""
    records.write.mode("append").partitionBy(target).parquet(path)
    return publish_receipts(records, order, target)


def defects_as_conflicts(defects: DataFrame) -> DataFrame:
    """Defect reports (record_id, rule) as new conflicts with origin `downstream`."""
    return defects.select("record_id", "rule", F.lit("downstream").alias("origin"), F.lit("open").alias("state"))


def queue_envelopes(df: DataFrame, queue: str, producer: str, document: str, page: str, payload: list[str]) -> DataFrame:
    """Rows as messages; trace_id is document:page."""
    trace = F.concat_ws(":", F.col(document).cast("string"), F.col(page).cast("string"))
    return df.select(F.lit(queue).alias("queue"), F.lit(producer).alias("producer"), trace.alias("trace_id"), F.to_json(F.struct(*payload)).alias("payload"))


def envelope_errors(messages: DataFrame, col: str) -> DataFrame:
    """Rows whose JSON message lacks a required key, with the missing keys."""
    keys = F.coalesce(F.map_keys(F.from_json(col, "map<string,string>")), F.array().cast("array<string>"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, ENVELOPE_KEYS)), keys))
    return messages.withColumn("missing", F.array_join(missing, ",")).filter("missing <> ''")
