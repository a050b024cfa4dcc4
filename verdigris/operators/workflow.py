"""Decisions, corrections, lifecycles and lanes built from the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.functions.text import edit_distance
from verdigris.operators.ordered import Machine, scan
from verdigris.operators.projections import OUTCOMES

#: Fixed values.
PROTECTED = ("area", "owner_name", "share_fraction", "survey_number")
FREE_EDITS = 4
CONFLICT_STATES = ("open", "referred", "resolved", "under_enquiry")
MODEL_KEYS = ("calibrator", "handwriting", "layout", "novelty", "ocr")
FAN_OUT = {"review": ["review_task:routed"], "audit_sample": ["review_task:audit", "audit_sample"], "conflict": ["conflict"], "outside_calibrated_regime": ["alert"], "auto_accept": []}


def decide(fields: DataFrame, decided: DataFrame) -> DataFrame:
    """One decision a field: new, replayed (same outcome), refused (another) or an error row."""
    one = fields.groupBy("id").agg(F.min_by("outcome", "ord").alias("outcome"))
    d = one.join(decided.select("id", F.col("outcome").alias("_had")), "id", "left")
    known = F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))
    status = F.when(~known, "error").when(F.col("_had").isNull(), "decided").when(F.col("_had") == F.col("outcome"), "replayed").otherwise("refused")
    return d.withColumn("status", status).withColumn("reason_code", F.when(status == "error", "unknown_outcome").when(status == "refused", "already_decided_otherwise")).drop("_had")


def fan_out(decisions: DataFrame) -> DataFrame:
    """Rows that new decisions open: tasks, samples, conflicts, alerts."""
    opens = F.array().cast("array<string>")
    for outcome, rows in FAN_OUT.items():
        opens = F.when(F.col("outcome") == outcome, F.array(*map(F.lit, rows)).cast("array<string>")).otherwise(opens)
    return decisions.filter("status = 'decided'").select("id", F.explode(opens).alias("opens"))


def submit_corrections(submits: DataFrame) -> DataFrame:
    """Distance of predicted and corrected; large changes of protected fields wait for a second person."""
    d = submits.withColumn("edit_distance", edit_distance(F.col("predicted"), F.col("corrected")))
    return d.withColumn("target", F.when(F.col("field_class").isin(*PROTECTED) & (F.col("edit_distance") > FREE_EDITS), "pending").otherwise("correction"))


def confirm_corrections(confirms: DataFrame, pending: DataFrame) -> DataFrame:
    """confirms (id, actor), pending (id, maker, claimant, resolved): another person than both, and only once."""
    d = confirms.join(pending, "id", "left")
    reason = F.when(F.col("maker").isNull(), "pending_not_found").when(F.col("resolved"), "already_resolved").when(F.col("actor") == F.col("maker"), "same_as_maker").when(F.col("actor").eqNullSafe(F.col("claimant")), "same_as_claimant")
    return d.select("id", "actor", reason.alias("reason_code"), reason.isNull().alias("confirmed"))


def conflict_step(state: str, event: tuple) -> tuple[str, str | None]:
    to, resolution = event
    if to not in CONFLICT_STATES:
        return state, "unknown_state"
    if to == state:
        return state, "same_state"
    return (state, "resolution_required") if to == "resolved" and resolution is None else (to, None)


def conflict_transitions(events: DataFrame) -> DataFrame:
    """events (id, ord, to, resolution): unknown or same state and resolving without a resolution are refused."""
    return scan(events, "id", ["ord"], ["to", "resolution"], Machine("open", conflict_step, lambda event: CONFLICT_STATES))


def rescan_step(state: str, event: tuple) -> tuple[str, str | None]:
    if event[0] == "assign":
        return ("assigned", None) if state == "open" else (state, "not_open")
    if event[0] == "close":
        return ("closed", None) if state != "closed" else (state, "already_closed")
    return state, None


def rescan_lifecycle(events: DataFrame) -> DataFrame:
    """events (id, ord, what): assign only while open, close unless closed."""
    return scan(events, "id", ["ord"], ["what"], Machine("open", rescan_step, lambda event: ("open", "assigned", "closed")))


def task_step(state: str, event: tuple) -> tuple[str, str | None]:
    what, actor = event
    if state == "closed":
        return state, "task_closed"
    if what == "claim":
        return (f"by:{actor}", None) if state == "free" else (state, "already_claimed")
    if state != f"by:{actor}":
        return state, "not_claimant"
    return ("closed" if what == "submit" else "free"), None


def task_lifecycle(events: DataFrame) -> DataFrame:
    """events (id, ord, what, actor): the state is free, closed or the claimant; submit and skip only by them."""
    return scan(events, "id", ["ord"], ["what", "actor"], Machine("free", task_step, lambda event: ("free", "closed", f"by:{event[1]}")))


def pin_envelopes(pages: DataFrame, pinned: DataFrame) -> DataFrame:
    """pages (page_id, ord, models map): the first envelope of each page not yet pinned, with exactly five models."""
    w = W.partitionBy("page_id").orderBy("ord")
    d = pages.join(pinned.select("page_id"), "page_id", "left_anti").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    want, have = F.array(*map(F.lit, MODEL_KEYS)), F.map_keys("models")
    reason = F.when(F.size(F.array_except(want, have)) > 0, "missing_model_version").when(F.size(F.array_except(have, want)) > 0, "unknown_model_version")
    return d.withColumn("reason_code", reason)


def tag_stream(corrections: DataFrame) -> DataFrame:
    """Stream of a correction by its origin."""
    return corrections.withColumn("stream", F.when(F.col("defect_origin") == "downstream", "downstream").when(F.col("defect_origin") == "legacy", "legacy_digital").when(F.col("source_stream") == "audit", "audit").otherwise("routed"))


def load_closed_sets(codes: DataFrame, loader: str) -> DataFrame:
    """Entries that a loader may write; other provenances are refused."""
    return codes.withColumn("reason_code", F.when(~(F.lit(loader).isin("schema", "lgd") & (F.col("provenance") == loader)), "provenance_not_allowed"))


def reprocess_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Records that differ under another config, with the changed fields."""
    o, n = old.select(key, *[F.col(f).alias(f"_o_{f}") for f in fields], F.lit(True).alias("_o")), new.select(key, *[F.col(f).alias(f"_n_{f}") for f in fields], F.lit(True).alias("_n"))
    d = o.join(n, key, "full")
    changed = F.array_join(F.filter(F.array(*[F.when(~F.col(f"_o_{f}").eqNullSafe(F.col(f"_n_{f}")), f) for f in fields]), lambda x: x.isNotNull()), ",")
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(changed != "", "changed")
    return d.select(key, kind.alias("kind"), changed.alias("changed")).filter("kind IS NOT NULL")


def impact_preview(diff: DataFrame) -> DataFrame:
    return diff.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def dead_letters(messages: DataFrame, most: int = 5) -> DataFrame:
    """messages (id, queue, attempts, failed): done, retried, or to the dead-letter queue with an audit row without payload."""
    dead = (F.col("attempts") > most) | (F.col("failed") & (F.col("attempts") >= most))
    out = F.when(dead, "dead_letter").when(F.col("failed"), "retry").otherwise("done")
    return messages.select("id", out.alias("outcome"), F.when(dead, F.concat("queue", F.lit(".DLQ"))).otherwise(F.col("queue")).alias("queue"))


def replay_from(landed: DataFrame, seq: str, after: int) -> DataFrame:
    """All messages after a given one, exclusive."""
    return landed.filter(F.col(seq) > after)


def text_lane(tokens: DataFrame, strokes: DataFrame) -> DataFrame:
    """tokens (page_id, id, text, doc_type, x, y, w, h, confidence) to fields with their strike status and bindings.

    A status is never live; a struck field is unknown here. A parcel's row names the
    owners and the share that its band binds to it. The fields are stored once, since
    the bands read them many times over.
    """
    from verdigris.operators.joins import bind_rows_by_band, struck
    from verdigris.operators.scoring import extract_fields
    from verdigris.operators.shared import stored

    marked = struck(extract_fields(tokens), strokes)
    fields = stored(marked.select("page_id", "id", "field_name", "raw_value", "canonical_value", "entry_status", "y", "confidence", (F.col("strokes") != "").alias("struck")), "fields")
    of = lambda name: fields.filter(F.col("field_name") == name).select("page_id", "id", "y", "confidence")
    bound = bind_rows_by_band(of("survey_number"), of("owner_name"), of("share_fraction")).select("page_id", F.col("parcel_id").alias("id"), "owner_ids", "share_id", "ambiguous")
    return fields.drop("confidence").join(bound, ["page_id", "id"], "left")


def text_lane_records(fields: DataFrame) -> DataFrame:
    """The lane's fields put together, a page a record, in the order of their rows; struck ones are left out."""
    from verdigris.operators.aggs import assemble_records

    rows = fields.filter("NOT struck").select(F.col("page_id").alias("record_id"), F.lit(1).alias("page_index"), F.col("y").alias("ord"), "id", "field_name", F.col("canonical_value").alias("value"))
    return assemble_records(rows)


def map_lane(polygons: DataFrame, labels: DataFrame, fits: DataFrame, most: float = 1.5) -> DataFrame:
    """Polygons (page_id, polygon_id, ring, crs), labels (page_id, label_id, text, x, y) and fits (page_id, a to f, rmse).

    Rings and labels are moved by their page's fit; rings are validated, bound within
    the page, measured by their crs and checked for eligibility. Without a fit there
    is no ground to measure on: the parcel is `not_georeferenced`.
    """
    from verdigris.functions.geometry import affine, clean_vertices, invalid_reason, polygon_area
    from verdigris.operators.aggs import ulpin_eligible
    from verdigris.operators.joins import bind_labels

    m = fits.select("page_id", "rmse", F.when(F.col("a").isNotNull(), F.struct(*"abcdef")).alias("m"))
    point = lambda x, y: [c.alias(n) for c, n in zip(affine(x, y, F.col("m")), "xy", strict=True)]
    moved = F.transform(clean_vertices(F.col("ring")), lambda p: F.struct(*point(p["x"], p["y"])))
    # Generators, so that no filter or later column works out a ring or its reason again.
    once = lambda c: F.explode(F.array(c))
    d = polygons.select("page_id", "polygon_id", "ring", "crs").join(m, "page_id", "left").select("page_id", "polygon_id", "crs", "m", once(F.when(F.col("m").isNotNull(), moved)).alias("ring"))
    d = d.select("*", once(F.when(F.col("m").isNull(), "not_georeferenced").otherwise(invalid_reason(F.col("ring")))).alias("invalid"))
    placed = labels.join(m.filter("m IS NOT NULL"), "page_id").select("page_id", "label_id", "text", *point(F.col("x"), F.col("y")))
    bound = bind_labels(d.filter("invalid IS NULL").select("page_id", "polygon_id", "ring"), placed, by=("page_id",)).withColumnRenamed("status", "label_status")
    d = d.join(bound, ["page_id", "polygon_id"], "left").withColumn("area", F.when(F.col("invalid").isNull(), polygon_area(F.col("ring"), F.col("crs"))).otherwise("0.00"))
    e = ulpin_eligible(d, fits, most)
    return d.join(e, ["page_id", "polygon_id"], "left").select("page_id", "polygon_id", "invalid", F.coalesce("label_status", F.lit("unbound")).alias("label_status"), "label_id", "text", "area", F.coalesce("eligible", F.lit(False)).alias("eligible"))
