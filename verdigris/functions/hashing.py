"""Digests, keyed hashes and audit shards as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARDS = 8


def shard_key(district: Column, batch: Column) -> Column:
    return F.when(district.isNotNull(), F.concat(F.lit("district:"), district)).when(batch.isNotNull(), F.concat(F.lit("batch:"), batch)).otherwise("system")


def shard_for(key: Column) -> Column:
    """SHA-256 of the key modulo 8, which the last hex digit decides; `system` is shard 0."""
    return F.when(key == "system", 0).otherwise(F.conv(F.substring(F.sha2(key, 256), 64, 1), 16, 10).cast("int") % SHARDS)


def hmac_hash(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex by two nested digests over padded keys."""
    block = (key if len(key) <= 64 else __import__("hashlib").sha256(key).digest()).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.sha2(F.concat(F.lit(inner), F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def iso(at: Column) -> Column:
    """A time as Python's isoformat gives it: six digits of fraction or none, and the offset."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.when(F.unix_micros(at.cast("timestamp")) % 1_000_000 == 0, whole).otherwise(micro), F.lit("+00:00"))
