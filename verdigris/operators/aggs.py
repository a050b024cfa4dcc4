"""Counts, calibration, assembly, affine fits, shares, Merkle roots."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from verdigris.operators.projections import OUTCOMES

#: Fixed values.
ACTIONS = {"pages_ingested": "page.ingested", "pages_processed": "page.processed", "records_published": "record.published"}


def page_activity(audit: DataFrame, district: str | None = None, since=None, until=None) -> DataFrame:
    """Counts of the three actions per district and day; since is inclusive, until exclusive."""
    d = audit.filter(F.col("action").isin(*ACTIONS.values()))
    if district is not None:
        d = d.filter(F.col("district") == district)
    if since is not None:
        d = d.filter(F.col("at") >= since)
    if until is not None:
        d = d.filter(F.col("at") < until)
    return d.groupBy(F.coalesce("district", F.lit("")).alias("district"), F.to_date("at").alias("day")).agg(*[F.count_if(F.col("action") == a).alias(n) for n, a in ACTIONS.items()])


def run_gaps(numbers: Column) -> Column:
    """The gaps between sorted distinct numbers as runs (first, last): as many as there are numbers, however wide they are."""
    pairs = F.zip_with(F.slice(numbers, 1, F.greatest(F.size(numbers) - 1, F.lit(0))), F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))), lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last")))
    return F.filter(pairs, lambda r: r["first"] <= r["last"])


def numbers_of(runs: Column) -> Column:
    """Runs spelled out; only for runs of a known width."""
    return F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["last"])))


def volume_completeness(pages: DataFrame, acknowledged: DataFrame | None = None) -> DataFrame:
    """pages (batch_id, position): observed (duplicates kept), gaps as runs (first, last) and state; an acknowledged batch stays so."""
    g = pages.groupBy("batch_id").agg(F.array_sort(F.collect_list("position")).alias("observed"))
    g = g.withColumn("gaps", run_gaps(F.array_distinct("observed")))
    state = F.when(F.size("observed") == 0, "pending").when(F.size("gaps") > 0, "gap_detected").otherwise("complete")
    g = g.withColumn("state", state)
    if acknowledged is not None:
        g = g.join(acknowledged.select("batch_id", F.lit(True).alias("_ack")).distinct(), "batch_id", "left").withColumn("state", F.when(F.col("_ack"), "acknowledged").otherwise(F.col("state"))).drop("_ack")
    return g


def page_terminal(extractions: DataFrame, done: DataFrame) -> DataFrame:
    """Pages of which every outcome is set, as long as they have not been reported."""
    g = extractions.groupBy("page_id").agg(F.bool_and(F.coalesce(F.col("routing_outcome").isin(*OUTCOMES), F.lit(False))).alias("ok"))
    return g.filter("ok").select("page_id").join(done.select("page_id"), "page_id", "left_anti")


def ece(df: DataFrame, by: list[str], prediction: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error per group, and n."""
    if bins <= 0:
        raise ValueError("bins must be positive")
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(prediction)))
    one = df.select(*by, p.alias("p"), F.col(label).cast("double").alias("y")).withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
    b = one.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("acc"), F.avg("p").alias("conf"))
    g = b.groupBy(*by) if by else b.groupBy()
    return g.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def evaluate_calibration(df: DataFrame, most: float, by: str = "stratum", least: int = 30) -> DataFrame:
    """ECE per stratum with its regime and whether it is acceptable."""
    e = ece(df, [by], "prediction", "is_correct")
    return e.withColumn("regime", F.when(F.col("n") >= least, "stratum_specific").otherwise("pooled_fallback")).withColumn("acceptable", F.col("ece") <= most)


def stratum_counts(df: DataFrame, least: int, by: str = "stratum") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).withColumn("own_model", F.col("n") >= least)


#: Missing pages of one gap that a record's rationale names one by one.
SPELLED = 1000


def assemble_records(extractions: DataFrame) -> DataFrame:
    """Rows (record_id, page_index, ord, id, field_name, value): fields, conflicts, ids, missing pages, strategy.

    The first value of a field wins; distinct values are kept in order. One shuffle
    by record_id gives a record's rows in order; all else comes from that array.
    """
    rows = F.array_sort(F.collect_list(F.struct("page_index", "ord", "id", "field_name", "value")))
    d = extractions.groupBy("record_id").agg(rows.alias("rows"))
    names = F.array_sort(F.array_distinct(F.transform("rows", lambda x: x["field_name"])))

    def field(name: Column) -> Column:
        return F.struct(name.alias("field_name"), F.transform(F.filter("rows", lambda x: x["field_name"].eqNullSafe(name)), lambda x: x["value"]).alias("all"))

    def summed(f: Column) -> Column:
        values = F.array_distinct(f["all"])
        return F.struct(f["field_name"].alias("field_name"), F.element_at(values, 1).alias("value"), (F.size(values) > 1).alias("conflicting"), (F.size(f["all"]) > F.size(values)).alias("duplicate"), values.alias("values"))

    d = d.select(
        "record_id",
        F.transform(F.transform(names, field), summed).alias("fields"),
        F.array_distinct(F.transform("rows", lambda x: x["page_index"])).alias("pages"),
        F.array_distinct(F.transform("rows", lambda x: x["id"])).alias("ids"),
    ).withColumn("pages", F.filter("pages", lambda p: p.isNotNull()))
    d = d.withColumn("missing", run_gaps(F.array_sort("pages")))
    page = lambda m: F.concat(F.lit("[MISSING_PAGE_GAP] page "), m.cast("string"))
    # A line a page for narrow gaps, one for all of a wide one.
    spelled = lambda m: F.when(m["last"] - m["first"] < SPELLED, F.transform(F.sequence(m["first"], F.least(m["last"], m["first"] + SPELLED)), page)).otherwise(F.array(F.concat(page(m["first"]), F.lit(" to "), m["last"].cast("string"))))
    lines = F.concat(
        F.flatten(F.transform("missing", spelled)),
        F.transform(F.filter("fields", lambda f: f["conflicting"]), lambda f: F.concat(F.lit("[CONFLICT] "), f["field_name"])),
        F.transform(F.filter("fields", lambda f: f["duplicate"]), lambda f: F.concat(F.lit("[DUPLICATE] "), f["field_name"])),
    )
    return d.withColumn("strategy", F.when(F.size("pages") > 1, "continuation").otherwise("single_page")).withColumn("rationale", F.array_join(lines, "; "))


def binding_confidence(scores: DataFrame, by: str) -> DataFrame:
    """Mean confidence of the parts, 0.0 if there are none."""
    return scores.groupBy(by).agg(F.coalesce(F.round(F.avg("confidence"), 2), F.lit(0.0)).alias("confidence"))


def dominant_route(regions: DataFrame) -> DataFrame:
    """Most frequent route of a page, the first seen on ties."""
    g = regions.groupBy("page_id", "route").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"))
    return g.groupBy("page_id").agg(F.max_by("route", F.struct("n", -F.col("first"))).alias("route"))


def fit_affine(gcps: DataFrame) -> DataFrame:
    """Least squares per page from centred sums: six coefficients and the RMSE; too few or collinear points are an error row."""
    m = gcps.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in ("pixel_x", "pixel_y", "geo_x", "geo_y")])
    c = gcps.join(m, "page_id").select("page_id", "n", *[F.col(f"m_{k}") for k in ("pixel_x", "pixel_y", "geo_x", "geo_y")], *[(F.col(k) - F.col(f"m_{k}")).alias(s) for k, s in (("pixel_x", "x"), ("pixel_y", "y"), ("geo_x", "u"), ("geo_y", "v"))])
    s = lambda a, b: F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}")
    g = c.groupBy("page_id", "n", "m_pixel_x", "m_pixel_y", "m_geo_x", "m_geo_y").agg(s("x", "x"), s("x", "y"), s("y", "y"), s("x", "u"), s("y", "u"), s("x", "v"), s("y", "v"), s("u", "u"), s("v", "v"))
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    ok = (F.col("n") >= 3) & (det > 1e-9 * F.greatest(F.lit(1e-12), F.col("sxx") * F.col("syy")))
    solve = lambda p, q: F.when(ok, (F.col(p) * F.col("syy") - F.col(q) * F.col("sxy")) / det), lambda p, q: F.when(ok, (F.col(q) * F.col("sxx") - F.col(p) * F.col("sxy")) / det)
    g = g.withColumn("a", solve[0]("sxu", "syu")).withColumn("b", solve[1]("sxu", "syu")).withColumn("d", solve[0]("sxv", "syv")).withColumn("e", solve[1]("sxv", "syv"))
    g = g.withColumn("c", F.col("m_geo_x") - F.col("a") * F.col("m_pixel_x") - F.col("b") * F.col("m_pixel_y")).withColumn("f", F.col("m_geo_y") - F.col("d") * F.col("m_pixel_x") - F.col("e") * F.col("m_pixel_y"))
    # Residuals on the points themselves: a difference of sums would lose digits.
    fit = gcps.join(g.select("page_id", *"abcdef"), "page_id")
    rx, ry = F.col("geo_x") - (F.col("a") * F.col("pixel_x") + F.col("b") * F.col("pixel_y") + F.col("c")), F.col("geo_y") - (F.col("d") * F.col("pixel_x") + F.col("e") * F.col("pixel_y") + F.col("f"))
    r = fit.groupBy("page_id").agg(F.round(F.sqrt(F.avg(rx * rx + ry * ry)), 4).alias("rmse"))
    return g.join(r, "page_id").select("page_id", "n", *"abcdef", "rmse", F.when(F.col("n") < 3, "too_few_points").when(F.col("a").isNull(), "degenerate_points").alias("reason_code"))


def ulpin_eligible(parcels: DataFrame, fits: DataFrame, most: float = 1.5) -> DataFrame:
    """Bound, valid parcels (page_id, polygon_id, invalid, label_status) with eligibility from the page's RMSE."""
    d = parcels.filter("invalid IS NULL AND label_status = 'bound'").join(fits.select("page_id", "rmse"), "page_id")
    return d.select("page_id", "polygon_id", F.coalesce(F.col("rmse") <= most, F.lit(False)).alias("eligible"))


@F.pandas_udf(IntegerType())
def _against_one(parts: pd.Series) -> pd.Series:
    """Sign of a sum of fractions less one, whatever the denominators; parts: (n, d) as text, one a denominator."""
    sums = (sum((Fraction(int(p["n"]), int(p["d"])) for p in row), Fraction(-1)) for row in parts)
    return pd.Series([(s > 0) - (s < 0) for s in sums], dtype="int32")


def share_sum_validate(shares: DataFrame) -> DataFrame:
    """Exact sum of fractions (record_id, n, d): over one blocks, under one is only flagged.

    Shares of equal denominators are added first. Where the product of a record's
    denominators and its shares fit a decimal, they decide; other records, those of
    dozens of different denominators, are added up as whole fractions.
    """
    whole = "decimal(38,0)"
    each = shares.groupBy("record_id", F.when(F.col("d") > 0, F.col("d")).alias("d")).agg(F.sum(F.col("n").cast(whole)).cast(whole).alias("n"))
    parts = each.groupBy("record_id").agg(F.collect_list(F.when(F.col("d").isNotNull(), F.struct(F.coalesce("n", F.lit(0)).cast("string").alias("n"), F.col("d").cast("string").alias("d")))).alias("parts"), F.bool_or(F.col("d").isNull()).alias("bad"))
    size = F.aggregate("parts", F.lit(0.0), lambda s, p: s + F.length(p["d"])) + F.coalesce(F.array_max(F.transform("parts", lambda p: F.length(p["n"]))), F.lit(0)) + F.length(F.size("parts").cast("string"))
    fits = parts.withColumn("_fits", size <= 36)
    den = F.aggregate("parts", F.lit(1).cast(whole), lambda s, p: (s * p["d"].cast(whole)).cast(whole))
    small = fits.filter("_fits").withColumn("den", den)
    num = F.expr("aggregate(parts, cast(0 as decimal(38,0)), (s, p) -> cast(s + cast(p.n as decimal(38,0)) * cast(den div cast(p.d as decimal(38,0)) as decimal(38,0)) as decimal(38,0)))")
    small = small.withColumn("sign", F.signum(num - F.col("den")).cast("int")).select("record_id", "bad", "sign")
    large = fits.filter("NOT _fits").select("record_id", "bad", _against_one("parts").alias("sign"))
    d = small.unionByName(large)
    code = F.when(F.col("bad"), "SHARE_UNPARSEABLE").when(F.col("sign") > 0, "SHARE_OVERSUM").when(F.col("sign") < 0, "SHARE_UNDERSUM")
    return d.select("record_id", code.alias("reason_code"), F.when(F.col("bad") | (F.col("sign") > 0), "fail").otherwise("pass").alias("verdict"))


def backlog(outbox: DataFrame, ceiling: int = 10_000, by: str | None = None) -> DataFrame:
    """Rows not yet dispatched and whether they exceed the ceiling (a signal only)."""
    d = outbox.filter("NOT dispatched")
    return (d.groupBy(by) if by else d.groupBy()).agg(F.count(F.lit(1)).alias("n")).withColumn("over_ceiling", F.col("n") > ceiling)


def shard_heads(spark: SparkSession, audit: DataFrame, shards: int = 8) -> DataFrame:
    """Latest hash of each shard; an empty shard stays, with null."""
    last = audit.groupBy("shard_id").agg(F.max_by("hash", F.struct("at", "id")).alias("head"))
    return spark.range(shards).select(F.col("id").cast("int").alias("shard_id")).join(last, "shard_id", "left")


def merkle_root(heads: DataFrame) -> DataFrame:
    """Root over the shards' heads in order: leaf sha256("shard:head"), pairs joined, an odd level repeats its last."""
    leaf = F.sha2(F.concat(F.col("shard_id").cast("string"), F.lit(":"), F.coalesce("head", F.lit(""))), 256)
    d = heads.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard_id", leaf.alias("h")))), lambda x: x["h"]).alias("level"))
    return d.select(root_of(F.col("level")).alias("root"))


def root_of(level: Column) -> Column:
    """Root of any number of leaves; no level is left to do after 32."""

    def up(v: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(v), F.lit(2)), lambda i: F.sha2(F.concat(F.element_at(v, i), F.coalesce(F.try_element_at(v, i + 1), F.element_at(v, i))), 256))
        return F.when(F.size(v) > 1, pairs).otherwise(v)

    top = F.aggregate(F.sequence(F.lit(1), F.lit(32)), level, lambda v, _: up(v))
    return F.coalesce(F.try_element_at(top, F.lit(1)), F.sha2(F.lit(""), 256))


def prototypes(embeddings: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean vector and count of each key."""
    n = embeddings.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    e = embeddings.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return e.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("prototype")).join(n, by)


def audit_agreement(samples: DataFrame, by: str) -> DataFrame:
    """Agreement of officers' verdicts; other verdicts count as errors."""
    ok = F.col("verdict").isin("agree", "disagree")
    return samples.groupBy(by).agg(F.count_if(ok).alias("n"), F.round(F.avg(F.when(ok, (F.col("verdict") == "agree").cast("double"))), 6).alias("rate"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("errors"))


def dedup_quality(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall of pairs (a, b) against true pairs."""
    p, t = pairs.select("a", "b", F.lit(1).alias("p")).distinct(), truth.select("a", "b", F.lit(1).alias("t")).distinct()
    d = p.join(t, ["a", "b"], "full")
    both = F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull())
    return d.agg(F.round(both / F.nullif(F.count("p"), F.lit(0)), 6).alias("precision"), F.round(both / F.nullif(F.count("t"), F.lit(0)), 6).alias("recall"))


def counted_quality(counts: DataFrame, found: Column, true: Column) -> DataFrame:
    """The same from numbers of pairs (n) by class, for conditions that a class decides."""
    both, p, t = (F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (found & true, found, true))
    return counts.agg(F.round(both / F.nullif(p, F.lit(0)), 6).alias("precision"), F.round(both / F.nullif(t, F.lit(0)), 6).alias("recall"))


def page_escalation(extractions: DataFrame, most: int) -> DataFrame:
    """A page with more routed fields than `most` goes to review whole."""
    g = extractions.groupBy("page_id").agg(F.count_if(F.col("routing_outcome") == "review").alias("routed"))
    return g.withColumn("escalated", F.col("routed") > most)


def record_error_policy(extractions: DataFrame, target: float) -> DataFrame:
    """Expected record error from its fields' confidences against the target (5 places; ties go up)."""
    c = F.greatest(F.lit(1e-9), F.col("confidence"))
    return extractions.groupBy("record_id").agg(F.round(1 - F.exp(F.sum(F.log(c))) + 1e-9, 5).alias("error")).withColumn("review", F.col("error") > target)


def promotion_gate(candidate: DataFrame, baseline: DataFrame, most_ece: float) -> DataFrame:
    """Strata of candidate (stratum, accuracy, ece, n) that regress or exceed the ECE; with the least effect n can show."""
    d = candidate.join(baseline.select("stratum", F.col("accuracy").alias("base")), "stratum", "left")
    effect = F.round(2.8 * F.sqrt(2 * F.col("base") * (1 - F.col("base")) / F.col("n")), 6)
    return d.select("stratum", (F.col("accuracy") < F.col("base")).alias("regressed"), (F.col("ece") > most_ece).alias("over_ece"), effect.alias("detectable"), (~(F.coalesce(F.col("accuracy") < F.col("base"), F.lit(False)) | (F.col("ece") > most_ece))).alias("promotable"))


def table_structure(cells: DataFrame, cuts: DataFrame) -> DataFrame:
    """cuts (page_id, xs, ys): grid size and mean confidence of filled cells."""
    g = cells.groupBy("page_id").agg(F.round(F.avg("confidence"), 4).alias("confidence"))
    d = cuts.join(g, "page_id", "left")
    return d.select("page_id", F.greatest(F.lit(1), F.size("ys") - 1).alias("rows"), F.greatest(F.lit(1), F.size("xs") - 1).alias("cols"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def expand_cells(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Merged cells (page_id, row, col, row_span, col_span, text) fill the grid; a later cell wins."""
    span = lambda at, n, most: F.explode(F.sequence(F.col(at), F.least(F.col(at) + F.greatest(F.col(n), F.lit(1)) - 1, F.lit(most - 1))))
    ok = cells.filter((F.col("row") < rows) & (F.col("col") < cols))
    d = ok.withColumn("r", span("row", "row_span", rows)).withColumn("c", span("col", "col_span", cols))
    return d.groupBy("page_id", "r", "c").agg(F.max_by("text", F.struct("row", "col")).alias("text"))


def cells_to_tokens(grid: DataFrame) -> DataFrame:
    """Filled cells as `[RrCc] text` in row-major order."""
    t = F.concat(F.lit("[R"), F.col("r").cast("string"), F.lit("C"), F.col("c").cast("string"), F.lit("] "), F.col("text"))
    return grid.filter("text <> ''").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", t.alias("t")))), lambda x: x["t"]), " ").alias("text"))


def missing_pages(pages: DataFrame) -> DataFrame:
    """Indices skipped between consecutive pages of a record, as runs (record_id, first, last)."""
    w = W.partitionBy("record_id").orderBy("page_index")
    d = pages.select("record_id", "page_index").distinct().withColumn("prev", F.lag("page_index").over(w)).filter("page_index > prev + 1")
    return d.select("record_id", (F.col("prev") + 1).alias("first"), (F.col("page_index") - 1).alias("last"))
