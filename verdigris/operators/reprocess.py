"""Re-derivation of published records under a corrected configuration.

Only records that the correction can reach are derived again: those whose latest
version is pinned to the old configuration and whose lineage names a rule that differs
between the two. Their inputs are picked by a semi-join before anything is derived;
where the inputs are stored in partitions by one of the keys, Spark reads only the
partitions that hold such records. Published rows are never changed: what differs
becomes a new version, and only material differences go to review. A second run finds
nothing to do, since the new versions are pinned to the new configuration.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.folds import next_versions
from verdigris.operators.shared import cut
from verdigris.operators.workflow import reprocess_diff


def changed_rules(rules: DataFrame, old: str, new: str) -> DataFrame:
    """rules (config_version, key, value): keys whose value differs between two versions, or that only one of them has."""
    side = lambda version, name: rules.filter(F.col("config_version") == version).select("key", F.col("value").alias(name), F.lit(True).alias(f"_{name}"))
    both = side(old, "old").join(side(new, "new"), "key", "full")
    same = F.col("old").eqNullSafe(F.col("new")) & F.col("_old").eqNullSafe(F.col("_new"))
    return both.filter(~same).select("key", "old", "new")


def latest(published: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each record."""
    rest = [c for c in published.columns if c not in keys]
    return published.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_last")).select(*keys, "_last.*")


def affected(published: DataFrame, lineage: DataFrame, rules: DataFrame, old: str, new: str, keys: list[str]) -> DataFrame:
    """Records to derive again, with how many changed rules each has used (`hits`).

    lineage (keys, key): the rules that a record was derived by. The rules are looked
    up first, so that records without a changed one drop out before any shuffle of
    published rows.
    """
    hits = lineage.join(changed_rules(rules, old, new).select("key"), "key", "left_semi").groupBy(*keys).agg(F.count_distinct("key").alias("hits"))
    pinned = latest(published, keys).filter(F.col("config_version") == old)
    return pinned.join(hits, keys)


def impact_preview(published: DataFrame, lineage: DataFrame, rules: DataFrame, old: str, new: str, keys: list[str]) -> DataFrame:
    """Per changed rule how many records it reaches; nothing is derived for it.

    Rules that no record has used count zero.
    """
    pinned = latest(published, keys).filter(F.col("config_version") == old).select(*keys)
    changed = changed_rules(rules, old, new)
    used = lineage.join(changed.select("key"), "key", "left_semi").distinct().join(pinned, keys, "left_semi")
    return changed.join(used.groupBy("key").agg(F.count(F.lit(1)).alias("records")), "key", "left").select("key", "old", "new", F.coalesce("records", F.lit(0)).cast("long").alias("records"))


@dataclass(frozen=True)
class Reprocessed:
    """changes: one row a record derived again; versions: what is to be published; review: material changes."""

    changes: DataFrame
    versions: DataFrame
    review: DataFrame


def reprocess(
    published: DataFrame,
    lineage: DataFrame,
    inputs: DataFrame,
    rules: DataFrame,
    old: str,
    new: str,
    derive: Callable[[DataFrame, DataFrame], DataFrame],
    fields: list[str],
    material: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    at: Column,
    keys: list[str] | None = None,
) -> Reprocessed:
    """Derive the affected records again, compare them with what is published, and version what differs.

    published (keys, version, config_version, fields), inputs (keys, ...), rules
    (config_version, key, value). `derive(inputs, rules)` gives keys and fields;
    `material(old, new)` says by the fields of both whether a change needs a
    review. A record that can't be derived any more is `removed`: it gets no version
    and always a review.
    """
    keys = keys or ["record_id"]
    reached = cut(affected(published, lineage, rules, old, new, keys)).filter("hits > 0")
    again = derive(inputs.join(reached.select(*keys), keys, "left_semi"), rules.filter(F.col("config_version") == new))
    # The comparison needs one key column.
    one = F.struct(*keys).alias("_key")
    diff = reprocess_diff(reached.select(one, *fields), again.select(one, *fields), "_key", fields)
    had = reached.select(*keys, "version", "hits", F.struct(*fields).alias("_had"))
    got = again.select(*keys, F.struct(*fields).alias("_got"))
    d = had.join(got, keys, "left").join(diff.select("_key.*", "kind", "changed"), keys, "left")
    d = d.withColumn("kind", F.coalesce("kind", F.lit("unchanged"))).withColumn("changed", F.when(F.col("kind") == "changed", F.col("changed")).otherwise(""))
    weighty = F.coalesce(material(lambda f: F.col(f"_had.{f}"), lambda f: F.col(f"_got.{f}")), F.lit(True))
    d = cut(d.withColumn("review", F.when(F.col("kind") == "changed", weighty).otherwise(F.col("kind") == "removed")))
    group = F.struct(*keys).alias("record_group")
    publishes = d.filter("kind = 'changed'").select(group, at.alias("at"), F.lit(new).alias("id"), "_got.*")
    versions = next_versions(publishes, d.select(group, "version"), []).select("record_group.*", "version", F.col("id").alias("config_version"), *fields)
    return Reprocessed(d.select(*keys, "kind", "changed", "hits", "version", "review", *[F.col(f"_got.{f}").alias(f) for f in fields]), versions, d.filter("review").select(*keys, "kind", "changed"))
