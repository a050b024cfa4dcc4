"""Row-wise rules: contracts, masking, permissions, lanes, drift, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.hashing import hmac_hash, shard_for, shard_key

#: Fixed values.
BANDS = ("good", "marginal", "poor")
STATUSES = ("amended", "cancelled", "live", "superseded", "unknown")
OUTCOMES = ("audit_sample", "auto_accept", "conflict", "outside_calibrated_regime", "review")
PERSONAL = ("address", "owner_name", "relationship")
UNMASKED_ROLE = "auditor_unmasked_read"
MASK = "•••"
UNIT_M2 = {"bigha": 1008.0}
TEXT_ROLES = ("endorsement", "tabular_register", "text")
MAP_TYPES = ("cadastral_map", "fmb_sketch")
ROUTES = {"map": ("map_sheet", 0.95), "table": ("tabular_register", 0.9), "handwritten_text": ("endorsement", 0.85)}


def violations(df: DataFrame, keep: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row for each broken rule; a rule is a condition that must hold (null counts as holding)."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()])
    return df.select(*keep, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def extraction_contract() -> dict[str, Column]:
    return {
        "legibility_band": F.col("legibility_band").isin(*BANDS),
        "entry_status": F.col("entry_status").isin(*STATUSES),
        "routing_outcome": F.col("routing_outcome").isin(*OUTCOMES),
        "field_name_required": F.col("field_name").isNotNull(),
    }


def force_not_applicable(df: DataFrame) -> DataFrame:
    """Consumed constraints force the verdict."""
    return df.withColumn("verdict", F.when(F.size(F.coalesce("consumed_constraints", F.array().cast("array<string>"))) > 0, "not_applicable").otherwise(F.col("verdict")))


def mark_live(df: DataFrame) -> DataFrame:
    """`live` only from `unknown`; anything else is an error row."""
    status = F.coalesce("entry_status", F.lit("unknown"))
    return df.withColumn("new_status", F.when(status == "unknown", "live").otherwise(status)).withColumn("reason_code", F.when(status != "unknown", "entry_status_not_unknown"))


def mask(df: DataFrame, role: str, field: str = "field_name", values: tuple[str, ...] = ("value", "raw_value"), crop: str | None = "crop_uri") -> DataFrame:
    """Values of personal fields and their crop link go together, unless the role may read them."""
    hide = F.coalesce(F.col(field).isin(*PERSONAL), F.lit(False)) if role != UNMASKED_ROLE else F.lit(False)
    for v in values:
        df = df.withColumn(v, F.when(hide & F.col(v).isNotNull(), MASK).otherwise(F.col(v)))
    if crop:
        df = df.withColumn(crop, F.when(~hide, F.col(crop)))
    return df.withColumn("masked", hide)


def mask_history(df: DataFrame, role: str, field: str = "field_class", history: str = "history") -> DataFrame:
    """The same for predicted and corrected in each entry of an edit history."""
    hide = F.col(field).isin(*PERSONAL) if role != UNMASKED_ROLE else F.lit(False)
    shown = lambda c: F.when(hide & c.isNotNull(), MASK).otherwise(c)
    return df.withColumn(history, F.transform(history, lambda h: F.struct(h["created_at"].alias("created_at"), shown(h["predicted"]).alias("predicted"), shown(h["corrected"]).alias("corrected"))))


def public_view(df: DataFrame, columns: list[str], times: tuple[str, ...] = ()) -> DataFrame:
    """Only the listed columns; times in ISO form."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if c in times else F.col(c) for c in columns])


def permissions_for(identities: DataFrame, matrix: DataFrame) -> DataFrame:
    """identities (user, role), matrix (role, permission): the permissions any of a user's roles grants."""
    return identities.join(matrix, "role").select("user", "permission").distinct()


def check_permissions(asked: DataFrame, granted: DataFrame) -> DataFrame:
    """asked (user, permission): add allowed and the audit action."""
    known = granted.withColumn("_has", F.lit(True))
    d = asked.join(known, ["user", "permission"], "left").withColumn("allowed", F.coalesce("_has", F.lit(False))).drop("_has")
    return d.withColumn("action", F.when(F.col("allowed"), "rbac.checked").otherwise("rbac.denied"))


def unmasked_read(df: DataFrame, purpose: str = "purpose") -> tuple[DataFrame, DataFrame]:
    """Fields read with a purpose, and one audit row for each of them."""
    ok = df.filter(F.trim(F.coalesce(purpose, F.lit(""))) != "")
    subject = F.concat_ws(":", F.col("record_id").cast("string"), F.col("version").cast("string"), F.col("field_name"))
    return ok, ok.select(F.lit("field.unmasked_read").alias("action"), subject.alias("subject"), F.col(purpose).alias("purpose"))


def lanes(df: DataFrame) -> DataFrame:
    """One row for each lane of a page; blank pages have none."""
    blank = F.col("page_role") == "blank"
    text = F.col("page_role").isin(*TEXT_ROLES)
    maps = (F.col("page_role") == "map_sheet") | F.col("doc_type").isin(*MAP_TYPES)
    found = F.array(F.when(~blank & text, "TEXT"), F.when(~blank & maps, "MAP"))
    return df.withColumn("lane", F.explode(F.filter(found, lambda x: x.isNotNull())))


def route_regions(pages: DataFrame) -> DataFrame:
    """pages (page_id, page_role, regions array<struct<type,confidence>> or null): one routed region a row.

    Without regions the page's role decides; else printed text with fallback_applied.
    """
    d = pages.select("*", F.posexplode_outer("regions").alias("position", "region"))
    kind, role = F.col("region.type"), F.col("page_role")
    given = F.when(kind.isin("map", "cadastral"), "map").when(kind.isin("table", "grid"), "table").when(kind.isin("handwritten", "signature"), "handwritten_text").otherwise("printed_text")
    default, sure = F.lit("printed_text"), F.lit(1.0)
    for route, (r, c) in ROUTES.items():
        default, sure = F.when(role == r, route).otherwise(default), F.when(role == r, c).otherwise(sure)
    none = F.col("region").isNull()
    return d.select("page_id", F.coalesce("position", F.lit(0)).alias("position"), F.when(none, default).otherwise(given).alias("route"), F.when(none, sure).otherwise(F.coalesce("region.confidence", F.lit(1.0))).alias("confidence"), (none & ~F.coalesce(role.isin(*[r for r, _ in ROUTES.values()]), F.lit(False))).alias("fallback_applied"))


def payload_drift(messages: DataFrame, state: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Messages whose non-null values differ from the stored row, with the names of those fields."""
    s = state.select(F.col(key), *[F.col(f).alias(f"_{f}") for f in fields])
    d = messages.join(s, key)
    names = F.filter(F.array(*[F.when(F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}")), f) for f in fields]), lambda x: x.isNotNull())
    return d.select(key, F.array_join(names, ",").alias("fields")).filter("fields <> ''")


def unit_convert(df: DataFrame, table: DataFrame) -> DataFrame:
    """df (district, amount), table (district, m2): area in square metres or a reason code."""
    t = table.select(F.lower(F.trim("district")).alias("_d"), "m2").distinct()
    d = df.withColumn("_d", F.lower(F.trim("district"))).join(t, "_d", "left").drop("_d")
    return d.withColumn("area_m2", F.col("amount") * F.col("m2")).withColumn("reason_code", F.when(F.col("m2").isNull(), "no_unit_table_for_district")).drop("m2")


def audit_rows(df: DataFrame, action: str, subject: Column, district: Column, value: Column | None = None, key: bytes = b"key", purpose: Column | None = None) -> DataFrame:
    """A result frame as audit rows; values only as keyed hashes."""
    return df.select(
        F.lit(action).alias("action"), subject.cast("string").alias("subject"), (purpose if purpose is not None else F.lit(None).cast("string")).alias("purpose"),
        (hmac_hash(value, key) if value is not None else F.lit(None).cast("string")).alias("value_hash"), district.alias("district"), shard_for(shard_key(district, F.lit(None).cast("string"))).alias("shard_id"),
    )


def matrix(spark: SparkSession, grants: dict[str, list[str]]) -> DataFrame:
    """A role and permission table from a fixed policy."""
    return spark.createDataFrame([(r, p) for r, ps in grants.items() for p in ps], "role string, permission string")
