"""Features, calibration, novelty, routing and validators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import canonical_value, classify_field, unconstrained_value
from verdigris.operators.shared import cut

#: The feature bands (other names score 0.5).
BAND_SCORE = {"good": 1.0, "medium": 0.5, "poor": 0.0}


def extract_fields(tokens: DataFrame) -> DataFrame:
    """Token rows (page_id, text, doc_type, ...) to field rows; blank tokens are dropped.

    The reading and its class are generated, so that neither is searched for again by what names them.
    """
    text = F.col("text")
    read = F.struct(unconstrained_value(text).alias("value"), classify_field(text, F.col("doc_type")).alias("kind"))
    d = tokens.withColumn("_read", F.explode(F.array(read))).filter(F.coalesce("_read.value", F.lit("")) != "").withColumn("field_name", F.col("_read.kind"))
    d = d.withColumn("raw_value", text).withColumn("unconstrained_value", F.col("_read.value")).withColumn("canonical_value", canonical_value(F.col("_read.kind"), text))
    return d.withColumn("entry_status", F.lit("unknown")).withColumn("calibrated_confidence", F.lit(None).cast("double")).withColumn("novelty_score", F.lit(None).cast("double")).drop("_read")


def numeric_features(df: DataFrame) -> DataFrame:
    """Add x: ten numbers. Missing ones are 0.5 with their flag set; without validators the pass ratio is 1."""
    out = []
    for c in ("token_confidence", "layout_certainty", "normalization_confidence"):
        out += [F.coalesce(F.col(c), F.lit(0.5)), F.col(c).isNull().cast("double")]
    n = F.size(F.coalesce("outcomes", F.array().cast("array<string>")))
    band = F.lit(0.5)
    for b, v in BAND_SCORE.items():
        band = F.when(F.col("legibility_band") == b, v).otherwise(band)
    out += [F.when(n > 0, F.size(F.filter("outcomes", lambda v: F.lower(v) == "pass")) / n).otherwise(1.0), (n == 0).cast("double"), band, (F.col("print_or_handwriting") == "handwritten").cast("double")]
    return df.withColumn("x", F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in out]))


def encode_features(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """The ten numbers followed by one-hot columns of the sorted categories."""
    hot = [(F.col(c) == v).cast("double") for c in ("field_class", "script", "doc_type") for v in sorted(categories.get(c, []))]
    d = numeric_features(df)
    return d.withColumn("x", F.concat("x", F.array(*[F.coalesce(h, F.lit(0.0)) for h in hot]))) if hot else d


def categories_of(df: DataFrame, columns: tuple[str, ...] = ("field_class", "script", "doc_type")) -> dict[str, list[str]]:
    """Distinct values of the category columns, a closed and small set, in one pass."""
    row = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def novelty(df: DataFrame, prototypes: DataFrame, by: str = "stratum", vector: str = "embedding", limit: float = 0.50) -> DataFrame:
    """Distance to the stratum's prototype over sqrt(dim), at most 1; an unseen stratum is outside with score 1."""
    d = df.join(prototypes.select(by, "prototype"), by, "left")
    same = F.size(vector) == F.size("prototype")
    sq = F.aggregate(F.zip_with(vector, "prototype", lambda a, b: F.pow(a.cast("double") - b, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    score = F.when(F.col("prototype").isNull(), 1.0).when(same, F.least(F.lit(1.0), F.sqrt(sq) / F.sqrt(F.size(vector).cast("double"))))
    d = d.withColumn("novelty_score", score)
    d = d.withColumn("outside", F.col("prototype").isNull() | (F.col("novelty_score") > limit))
    return d.withColumn("reason_code", F.when(F.col("prototype").isNull(), "unseen_stratum").when(~same, "dimension_mismatch").when(F.col("outside"), "distance_over_limit")).drop("prototype")


def route_fields(df: DataFrame, target: float, postures: tuple[str, ...] = ("steady",)) -> DataFrame:
    """confidence, outside, conflict, state, sampled: the first rule that applies gives the outcome (>= is enough)."""
    return df.withColumn("outcome", F.when(F.col("outside"), "outside_calibrated_regime").when(F.col("conflict"), "conflict").when(F.col("confidence") < 1 - target, "review").when(~F.col("state").isin(*postures), "review").when(F.col("sampled"), "audit_sample").otherwise("auto_accept"))


def apply_calibrator(df: DataFrame, models: DataFrame, pooled: list[float] | None, bias: float = 0.0) -> DataFrame:
    """models (stratum, w, b): sigmoid of w.x + b, the stratum's model else the pooled one, else 0.98 of the token's confidence."""
    d = df.join(models.select("stratum", F.col("w").alias("_w"), F.col("b").alias("_b")), "stratum", "left")
    default = F.array(*map(F.lit, pooled)) if pooled else F.lit(None).cast("array<double>")
    d = d.withColumn("_u", F.coalesce("_w", default)).withColumn("_v", F.when(F.col("_w").isNotNull(), F.col("_b")).otherwise(bias))
    parts = F.zip_with("_u", "x", lambda a, b: a * b)
    z = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.aggregate(parts, F.lit(0.0), lambda s, p: s + p) + F.col("_v")))
    p = F.when(F.col("_u").isNull(), 0.98 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("token_confidence")))).otherwise(1 / (1 + F.exp(-z)))
    named = F.filter(F.transform(parts, lambda v, i: F.struct(i.alias("feature"), F.round(v, 6).alias("v"))), lambda s: F.abs(s["v"]) > 1e-5)
    return d.withColumn("confidence", p).withColumn("attributions", named).withColumn("regime", F.when(F.col("_w").isNotNull(), "stratum_specific").when(F.col("_u").isNotNull(), "pooled_fallback").otherwise("unfitted")).drop("_w", "_b", "_u", "_v")


def descend(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 150, rate: float = 0.5, l2: float = 0.01) -> tuple[np.ndarray, float]:
    """Batch gradient descent from zero; the penalty is on the weights only."""
    w, b, total = np.zeros(x.shape[1]), 0.0, n.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50)))
        g = n * (p - y)
        w, b = w - rate * (x.T @ g / total + l2 * w), b - rate * g.sum() / total
    return w, float(b)


#: Distinct rows of a model that one task may hold; beyond that its gradients are summed by Spark.
BATCH = 100_000


def train_calibrators(labels: DataFrame, least: int, batch: int = BATCH, steps: int = 150, rate: float = 0.5, l2: float = 0.01) -> DataFrame:
    """labels (stratum, x, y): one model for each stratum of at least `least` rows and a pooled one (stratum `*`).

    Equal rows are collapsed to weights first. A model of at most `batch` distinct
    rows is fitted in one task; all larger ones descend together, a step being one
    pass over their rows and one sum of gradients.
    """
    weighted = labels.groupBy("stratum", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    large = labels.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("stratum")
    every = weighted.groupBy("x", "y").agg(F.sum("n").alias("n")).select(F.lit("*").alias("stratum"), "x", "y", "n")
    rows = cut(weighted.join(large, "stratum", "left_semi").unionByName(every))
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("total"), F.max(F.size("x")).alias("dim"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        w, b = descend(np.array(pdf["x"].tolist()), pdf["y"].to_numpy(float), pdf["n"].to_numpy(float), steps, rate, l2)
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "w": [w], "b": [b]})

    small = rows.join(sizes.filter(F.col("_rows") <= batch), "stratum", "left_semi").groupBy("stratum").applyInPandas(fit, MODELS)
    # One entry a model that no task can hold, so at most one for each `batch` distinct rows.
    wide = sizes.filter(F.col("_rows") > batch).collect()
    return small.unionByName(_descend_together(rows, wide, steps, rate, l2)) if wide else small


MODELS = "stratum string, w array<double>, b double"


def gradients(batches: Iterator[pa.RecordBatch], models: dict[str, tuple[np.ndarray, float]]) -> Iterator[pa.RecordBatch]:
    """Each batch's sums of n (p - y) x, and of n (p - y) as the last entry, by model."""
    for batch in batches:
        y, n = (batch.column(c).to_numpy().astype(float) for c in ("y", "n"))
        ends = batch.column("x").offsets.to_numpy()
        x = batch.column("x").flatten().to_numpy().reshape(len(y), -1) if len(y) else np.zeros((0, 0))
        assert not len(y) or (np.diff(ends) == x.shape[1]).all(), "rows of a model differ in length"
        name = np.array(batch.column("stratum").to_pylist(), object)
        for m in set(name):
            at = name == m
            w, b = models[m]
            g = n[at] * (1 / (1 + np.exp(-np.clip(x[at] @ w + b, -50, 50))) - y[at])
            sums = np.append(x[at].T @ g, g.sum())
            yield pa.RecordBatch.from_pydict({"stratum": [m] * len(sums), "entry": np.arange(len(sums), dtype=np.int32), "g": sums})


def _descend_together(rows: DataFrame, wide: list, steps: int, rate: float, l2: float) -> DataFrame:
    """Batch descent of all models in `wide` (stratum, total, dim); what is broadcast and collected is their weights."""
    spark = rows.sparkSession
    models = {r["stratum"]: (np.zeros(r["dim"]), 0.0) for r in wide}
    total = {r["stratum"]: float(r["total"]) for r in wide}
    names = spark.createDataFrame([(m,) for m in models], "stratum string")
    # Cached between the steps; a lost executor's part is read again from the checkpoint.
    mine = rows.join(names, "stratum", "left_semi").persist()
    for _ in range(steps):
        now = spark.sparkContext.broadcast(models)
        parts = mine.mapInArrow(lambda batches, now=now: gradients(batches, now.value), "stratum string, entry int, g double")
        sums: dict[str, np.ndarray] = {m: np.zeros(len(w) + 1) for m, (w, _) in models.items()}
        for r in parts.groupBy("stratum", "entry").agg(F.sum("g").alias("g")).collect():
            sums[r["stratum"]][r["entry"]] = r["g"]
        models = {m: (w - rate * (sums[m][:-1] / total[m] + l2 * w), b - rate * sums[m][-1] / total[m]) for m, (w, b) in models.items()}
        now.destroy()
    mine.unpersist()
    return spark.createDataFrame([(m, w.tolist(), float(b)) for m, (w, b) in models.items()], MODELS)


def syntactic_validate(df: DataFrame) -> DataFrame:
    """Formats of canonical values by field: verdict, reason and the field looked at."""
    rules = {"survey_number": r"^[0-9]+(/[0-9]+)*$", "khata_number": r"^[0-9]+$", "share_fraction": r"^[0-9]+/[1-9][0-9]*$", "area": r"^[0-9]+(\.[0-9]+)? [a-z]+$", "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"}
    ok, known = F.lit(None).cast("boolean"), F.lit(False)
    for f, p in rules.items():
        ok, known = F.when(F.col("field_name") == f, F.col("canonical_value").rlike(p)).otherwise(ok), known | (F.col("field_name") == f)
    verdict = F.when(~known, "not_applicable").when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")
    return df.withColumn("verdict", verdict).withColumn("reason_code", F.when(verdict == "fail", F.concat(F.lit("FORMAT_"), F.upper("field_name"))))


def geospatial_validate(parcels: DataFrame, units: DataFrame, tolerance: float) -> DataFrame:
    """parcels (id, district, recorded, area_m2): the recorded area against the polygon's, in the district's unit."""
    t = units.select(F.lower(F.trim("district")).alias("_d"), "m2").distinct()
    d = parcels.withColumn("_d", F.lower(F.trim("district"))).join(t, "_d", "left")
    far = F.abs(F.col("recorded") * F.col("m2") - F.col("area_m2")) > tolerance * F.col("area_m2")
    return d.select("id", F.when(F.col("m2").isNull(), "UNIT_TABLE_UNVERIFIED").when(far, "AREA_DISAGREES").alias("reason_code"), F.when(F.col("m2").isNull(), "not_applicable").when(far, "fail").otherwise("pass").alias("verdict"))


def checked(scored: DataFrame, pins: tuple[str, ...] = ("calibrator", "novelty")) -> DataFrame:
    """Missing pins or confidences out of range are error rows without an outcome."""
    error = F.when(F.size(F.array_except(F.array(*map(F.lit, pins)), F.map_keys("pins"))) > 0, "missing_pinned_version").when(~F.col("confidence").between(0, 1), "confidence_out_of_range")
    return scored.withColumn("reason_code", error).withColumn("outcome", F.when(F.col("reason_code").isNull(), F.col("outcome")))


def score_fields(fields: DataFrame, prototypes: DataFrame, models: DataFrame, pooled: list[float] | None, target: float, bias: float = 0.0, limit: float = 0.50) -> DataFrame:
    """Novelty first, then calibration, conflict flag and route, in one plan."""
    d = novelty(fields, prototypes, limit=limit).withColumnRenamed("reason_code", "novelty_reason")
    return checked(route_fields(apply_calibrator(d, models, pooled, bias), target))
