"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words. Targets come from the weights; no source gives more than
`epochs` times its own size, and what is cut off there is shared again by weight
among the others. The total is then laid out in equal blocks of `block` words.
Sources get whole blocks by the highest quotients target / (2k + 1), and each
source's blocks go to its shards in the same way, by shard size. Inside a shard
the documents stand in a seeded order, repeated as often as needed, and the
shard's quota is taken as a run of blocks from a seeded first block, so that the
result only depends on the rows and the seed.

All parts are joins, grouped sums and windows. Words are counted once, in a scan
that leaves (doc_id, source, size) for each row; the plan comes from that. A source
is dealt to as many shards as its rows ask for, so no window holds more than about
`shard_rows` rows even if one source has a third of all. Tables of one row per
source or shard are small against the documents, and they are never collected.

Nulls: a null text has 0 words; a null source is a source of its own, ordered
last; rows with a null doc_id take part. Repeated rows are rows of their own and
are told apart by nothing, so which of them is taken may swap, with equal counts.
Documents of 0 words take 0. Very long texts count whole; a text longer than a
block is cut between blocks like any other. An empty table gives an empty table.
Extra columns are kept, whatever their names; those named like the result's columns
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm.common import cut, n_words, written

SALTS = 64
OWN = ("size", "source_size", "target", "taken")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """`sizes` (source, source_size): add target, the source's words in the mix.

    Sources in code point order (null last) have the weights in turn. Sorted by
    epochs * size / weight, the capped sources come first: one is capped if what
    is left, shared by the weights that are left, reaches its cap.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double")
    s = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    full = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(full).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = rest / (F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("share", share).withColumn("free", F.col("weight") * F.col("share") < F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "share"))).over(full)["share"]
    s = s.withColumn("level", level)
    return s.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target"))


def apportion(parts: DataFrame, over: list[str], share: str, total: str, tie: list[Column], out: str) -> DataFrame:
    """Sainte-Laguë: split `total` whole blocks of each group `over` by `share`.

    With n parts the divisor lies between sum/(total + n/2) and sum/(total - n/2),
    which fixes all but about 2n seats; only those compete by their quotients.
    """
    group = W.partitionBy(*over) if over else W.partitionBy(F.lit(0))
    sure = (
        parts.withColumn("_n", F.count(F.lit(1)).over(group))
        .withColumn("_sum", F.sum(share).over(group))
        .withColumn("_exact", F.when(F.col("_sum") > 0, F.col(share) / F.col("_sum")).otherwise(0.0))
    )
    t, half = F.col(total).cast("double"), F.col("_n") / 2
    sure = sure.withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_exact") * (t - half) - 1)).cast("long"))
    sure = sure.withColumn("_high", F.least(F.col(total).cast("long"), F.ceil(F.col("_exact") * (t + half) + 1).cast("long")))
    sure = sure.withColumn("_open", F.col(total) - F.sum("_low").over(group))
    seats = sure.filter((F.col("_high") > F.col("_low")) & (F.col(share) > 0)).withColumn("_k", F.explode(F.expr("sequence(_low, _high - 1)")))
    rank = F.row_number().over(group.orderBy((F.col(share) / (2 * F.col("_k") + 1)).desc(), *tie))
    won = seats.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_open"))
    keys = [c for c in parts.columns if c != total and c != share]
    won = won.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("\0null")).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_won"))
    on = [F.coalesce(sure[k].cast("string"), F.lit("\0null")) == won[f"_key{i}"] for i, k in enumerate(keys)]
    return sure.join(won, on, "left").select(*parts.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias(out))


def shares(rows: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, block: int | None = None, shard_rows: int = 2000) -> DataFrame:
    """Add source_size, target and taken to `rows` (doc_id, source, size and, if any, `row`).

    `block`: words in a block; by default a hundredth of the smallest positive
    target, 4096 at most, so that rounding stays under a hundredth of each target.
    """
    carried = rows.columns
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    goal = targets(sizes.select("source", "source_size"), weights, epochs)
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    plan = goal.join(sizes.select(key.alias("key"), "rows"), F.col("key") == key).drop("source")
    every = W.partitionBy(F.lit(0))
    unit = F.lit(float(block)) if block else F.greatest(F.lit(1.0), F.least(F.lit(4096.0), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every) / 100)))
    plan = plan.withColumn("block", F.coalesce(unit, F.lit(1.0))).withColumn("blocks", F.round(F.sum("target").over(every) / F.col("block")).cast("long"))
    quota = apportion(plan.select("key", "target", "blocks"), [], "target", "blocks", [F.col("key")], "quota").select("key", "quota")
    # One row per source; what follows reads it several times.
    plan = cut(plan.join(quota, "key").withColumn("shards", F.ceil(F.col("rows") / shard_rows).cast("long")).drop("rows"))

    # Each source's row is copied for all salts, so that a hot source's documents
    # meet it in as many tasks.
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("key", key).withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).withColumn("at", F.xxhash64(F.lit(seed), "doc_id", F.col("size")))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("at")), F.col("shards")))
    cells = dealt.groupBy("key", "shard").agg(F.sum("size").alias("cell"), F.first("quota").alias("quota"))
    given = apportion(cells.select("key", "shard", "cell", "quota"), ["key"], "cell", "quota", [F.col("shard")], "given")
    cells = cut(given.select("key", "shard", "cell", "given"))
    row = W.partitionBy("key", "shard").orderBy("at", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.join(cells, ["key", "shard"]).withColumn("from", F.coalesce(F.sum("size").over(row), F.lit(0)))
    # The run of blocks: `rounds` whole passes over the shard and `rest` words from `start`, around its end.
    cap = F.col("cell") * epochs
    words = F.when(F.col("target") >= F.col("source_size") * epochs, cap).otherwise(F.least(cap, (F.col("given") * F.col("block")).cast("long")))
    placed = placed.withColumn("take", words).withColumn("rounds", F.expr("if(cell > 0, take div cell, 0L)")).withColumn("rest", F.col("take") - F.col("rounds") * F.col("cell"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("cell") / F.col("block"))).cast("long")
    placed = placed.withColumn("start", F.least("cell", (F.pmod(F.xxhash64(F.lit(seed + 2), "key", "shard"), blocks) * F.col("block")).cast("long")))
    end, to = F.col("start") + F.col("rest"), F.col("from") + F.col("size")
    meet = lambda a, b: F.greatest(F.lit(0), F.least(to, b) - F.greatest(F.col("from"), a))
    taken = F.col("rounds") * F.col("size") + meet(F.col("start"), F.least(end, F.col("cell"))) + meet(F.lit(0), end - F.col("cell"))
    return placed.select(*carried, "source_size", "target", taken.cast("long").alias("taken"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every row, checkpointed: the only pass over the texts that the plan needs."""
    return cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Add size, source_size, target and taken to `docs` (doc_id, text, source, ...); see `shares` for the options."""
    kept = [c for c in docs.columns if c.lower() not in OWN]
    rows = docs.select(F.struct(*kept).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    return shares(cut(rows), **options).select("row.*", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of `docs`: each as often as its words are taken, to the nearest whole.

    How often each row is taken is a table of row hashes, which grows with the
    documents, so the texts meet it by a shuffled join at every size. Rows that are
    equal in doc_id, source and text share their copies evenly.
    """
    # The digest alone passes over nulls, so it takes in which of the values are null.
    parts = ["doc_id", "source", "text"]
    digest = F.xxhash64(*[F.col(c).isNull() for c in parts], *parts)
    rows = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest.alias("row")))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    copies = shares(rows, **options).groupBy("row").agg(F.sum(times).alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0")
    copies = cut(copies.select(F.col("row").alias("digest"), F.expr("copies div rows").alias("each"), F.expr("copies % rows").alias("more")))
    packed = docs.select(F.struct(*docs.columns).alias("row"), digest.alias("digest"))
    even, uneven = (written(copies.filter(p), "copies") for p in ("more = 0", "more > 0"))
    again = lambda n: F.explode(F.expr(f"if({n} > 0, sequence(1L, {n}), array())"))
    out = packed.join(even.hint("shuffle_merge"), "digest").select("row", again("each"))
    if not uneven.isEmpty():
        turn = F.row_number().over(W.partitionBy("digest").orderBy("digest"))
        part = packed.join(uneven, "digest").withColumn("n", F.col("each") + (turn <= F.col("more")).cast("long"))
        out = out.unionByName(part.select("row", again("n")))
    return out.select("row.*")
