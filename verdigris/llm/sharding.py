"""Balanced label propagation: documents to shards, linked ones together.

Documents with equal texts are linked through a common node (the digest of the
text), so a group of any size costs one row a document and never its pairs.
Each starts on a hashed shard. In every round the shards that hold most of a
group attract its other documents (as many shards as the group would fill), and
moves are accepted up to the capacity that linked documents have left in the
target; small parts of a group move whole, large ones by their documents'
hashes. Documents without links are the filling: at the end, what stands above a
shard's quota, unlinked documents first, goes to the shards that lack rows.

Counts per shard differ by one at most. What is collected is one row a shard or
a pair of shards. Ranks are built from counts of small cells, so no task sees a
whole shard.

Nulls: a null text has size 8, CRC 0 and counts as an empty text; a null doc_id is
a row like any other. Very long texts count whole and are not moved. Ties between
shards go to the smaller number. Repeated rows are rows of their own. An empty
table gives an empty one. Extra columns are not needed and not read, so their names
don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm.common import cut


def linked_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, node (digest of the text)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(F.encode(text, "UTF-8")).alias("node"))


def _cases(column: Column, values: dict[int, int]) -> Column:
    """The value of a shard number (a few dozen entries)."""
    return F.element_at(F.array(*[F.lit(values[k]) for k in sorted(values)]), (column + 1).cast("int"))


def propagate(state: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """Rounds of moves over `state` (linked documents: doc_id, size, text_crc32, node, shard)."""
    for r in range(rounds):
        cells = state.groupBy("node", "shard").agg(F.count(F.lit(1)).alias("n"))
        by_node = W.partitionBy("node")
        ranked = cells.withColumn("place", F.row_number().over(by_node.orderBy(F.desc("n"), "shard"))).withColumn("need", F.ceil(F.sum("n").over(by_node) / quota))
        homes = F.array_sort(F.collect_list(F.when(F.col("place") <= F.col("need"), F.struct("place", "shard"))).over(by_node))
        ranked = ranked.withColumn("homes", homes)
        to = F.element_at("homes", (F.pmod(F.xxhash64("node", "shard"), F.size("homes")) + 1).cast("int"))["shard"]
        wish = cut(ranked.filter(F.col("place") > F.col("need")).select("node", "shard", "n", to.alias("to")))
        asked = wish.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()
        if not asked:
            break
        held = {s: 0 for s in range(shards)} | {x["shard"]: x["n"] for x in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        wanted, leaving = {s: 0 for s in range(shards)}, {s: 0 for s in range(shards)}
        for x in asked:
            wanted[x["to"]] += x["n"]
            leaving[x["shard"]] += x["n"]
        # Half of those who wish to leave are counted on; the end evens out the rest.
        room = {s: max(0, quota - held[s] + leaving[s] // 2) for s in range(shards)}
        share = {s: int(1_000_000 * min(1.0, room[s] / max(1, wanted[s]))) for s in range(shards)}
        large = F.col("n") > max(1, quota // 50)
        free = lambda *c: F.pmod(F.xxhash64(F.lit(r), *c), F.lit(1_000_000)) < _cases(F.col("to"), share)
        moves = wish.select("node", "shard", "to", "n")
        goes = F.col("to").isNotNull() & F.when(large, free("doc_id", "node")).otherwise(free("node", "shard"))
        state = cut(state.join(moves, ["node", "shard"], "left").select("doc_id", "size", "text_crc32", "node", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard")))
    return state


def shard(docs: DataFrame, shards: int = 24, rounds: int = 3, cell_rows: int = 500) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 within the shard)."""
    rows = cut(linked_rows(docs))
    total = rows.count()
    quota = max(1, total // shards)
    # Cut, so that the join below stands on two exchanges and Spark can split a hot node's rows.
    groups = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("node", F.lit(True).alias("linked")))
    start = F.pmod(F.xxhash64("doc_id", "node"), F.lit(shards)).cast("int").alias("shard")
    marked = cut(rows.join(groups, "node", "left").select("doc_id", "size", "text_crc32", "node", start, F.coalesce("linked", F.lit(False)).alias("linked")))
    moved = propagate(marked.filter("linked").drop("linked"), shards, quota, rounds)
    placed = moved.withColumn("linked", F.lit(True)).unionByName(marked.filter("NOT linked"))

    # Ranks within a shard: linked documents first, from counts of cells of about cell_rows.
    spread = max(1, total // (shards * cell_rows))
    deep = max(1, int(spread**0.5))
    cell = F.pmod(F.xxhash64("node"), F.lit(max(1, spread // deep))) * deep + F.pmod(F.xxhash64("doc_id"), F.lit(deep))
    placed = placed.withColumn("part", F.when(F.col("linked"), 0).otherwise(1)).withColumn("cell", cell)
    cells = placed.groupBy("shard", "part", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("part", "cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("shard", "part", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("shard", "part", "cell").orderBy("node", "doc_id")
    ranked = placed.withColumn("rank", F.row_number().over(inside) - 1).join(cells, ["shard", "part", "cell"]).withColumn("rank", F.col("rank") + F.col("offset"))

    counts = {s: 0 for s in range(shards)} | {x["shard"]: x["n"] for x in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    fair = {s: total // shards + (s < total % shards) for s in range(shards)}
    over, lack, given, gaps = {}, [], 0, 0
    for s in range(shards):
        over[s] = given
        given += max(0, counts[s] - fair[s])
        if counts[s] < fair[s]:
            lack.append((gaps, s))
            gaps += fair[s] - counts[s]
    turn = F.col("rank") - _cases(F.col("shard"), fair) + _cases(F.col("shard"), over)
    new_shard, new_slot = F.col("shard"), F.col("rank")
    if lack:
        chain, slots = F.lit(lack[0][1]), turn + counts[lack[0][1]]
        for first, s in lack[1:]:
            chain = F.when(turn >= first, F.lit(s)).otherwise(chain)
            slots = F.when(turn >= first, turn - first + counts[s]).otherwise(slots)
        surplus = F.col("rank") >= _cases(F.col("shard"), fair)
        new_shard, new_slot = F.when(surplus, chain).otherwise(new_shard), F.when(surplus, slots).otherwise(new_slot)
    return ranked.select("doc_id", "size", "text_crc32", new_shard.cast("int").alias("shard"), new_slot.cast("long").alias("slot"))
