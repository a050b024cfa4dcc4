"""How filters that run one after the other overlap: who removes what in every order.

Each document fails a set of filters, which is one cell of a table of 2 x 2 x 2 x 2 x 2
counts. Spark counts the cells of each part (all, labelled good, labelled toxic); every
figure of every order is then a contraction of that small table: along each filter's
axis a step takes the documents that pass, those that fail, or all of them.

Ties, repeated rows and nulls: a null text counts as empty, a null part as the empty
string. A row fails the copy filter if a smaller doc_id has its text; rows that repeat
the smallest doc_id are no copies of each other, a null doc_id is larger than all
others. A document is good (toxic) if any of its labels says so; labels without a
doc_id say nothing. An empty table has no parts and gives no rows. Texts of any length
are looked at whole, in time near their length; only 32 bytes of digest a document
are shuffled. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import let, words

NAMES = "ABCDE"
MEASURES = ("n", "good", "toxic")
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: What a step takes along an axis: weights of (passes, fails).
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text: A to D."""
    text = F.coalesce(text, F.lit(""))
    counts = let(words(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("k")))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": counts["n"] < 100,
        "B": counts["k"].cast("long") * 100 < counts["n"].cast("long") * 80,
        "C": upper * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, code (bit i: fails filter i) and the counts n, good and toxic of each cell.

    Of equal texts all but the rows of the smallest doc_id fail the copy filter. So
    no row has to meet its group: all rows are counted without that bit, the rows of
    each group's smallest doc_id once more, and the difference has the bit.
    """
    fails = text_failures(F.col("text"))
    code = sum((F.when(c, 1 << NAMES.index(k)).otherwise(0) for k, c in fails.items()), F.lit(0)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_sha"), code.alias("code"))
    flags = labels.filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    flags = flags.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"))
    rows = rows.join(flags, "doc_id", "left")
    sums = [F.sum(F.lit(1).cast("long")).alias("n"), *(F.sum(F.coalesce(c, F.lit(0).cast("long"))).alias(c) for c in MEASURES[1:])]
    by_doc = rows.groupBy("text_sha", "doc_id", "part", "code").agg(*sums)
    # A group's smallest doc_id with its rows by part; a null doc_id comes last.
    listed = by_doc.groupBy("text_sha", "doc_id", "code").agg(F.sort_array(F.collect_list(F.struct("part", *MEASURES))).alias("rows"))
    first = listed.groupBy("text_sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "code", "rows")).alias("first"))
    first = first.select("first.code", F.explode("first.rows").alias("row")).select("row.part", "code", *(f"row.{m}" for m in MEASURES))
    copy = 1 << NAMES.index("E")
    whole = by_doc.select("part", F.col("code").bitwiseOR(copy).alias("code"), *MEASURES)
    taken = first.select("part", F.col("code").bitwiseOR(copy).alias("code"), *(-F.col(m) for m in MEASURES))
    return whole.toDF(*first.columns).unionByName(taken.toDF(*first.columns)).unionByName(first).groupBy("part", "code").agg(*(F.sum(m).alias(m) for m in MEASURES))


def contracted(tables: np.ndarray, takes: np.ndarray) -> np.ndarray:
    """Sums (part, step, measure) of tables (part, 2, 2, 2, 2, 2, measure) by takes (step, filter, 2)."""
    return np.einsum("pabcdem,sa,sb,sc,sd,se->psm", tables, *(takes[:, i] for i in range(len(NAMES))), optimize=True)


def audit(tables: np.ndarray) -> list[np.ndarray]:
    """The figures of SCHEMA from `kept` on, each (part, order, step), of tables as in `contracted`."""
    orders = np.array(list(permutations(range(len(NAMES)))))
    size = orders.shape

    def taken(choice) -> np.ndarray:
        """The sums where choice(rank of a filter against the step's, whether it is the step's) says what is taken."""
        rank = np.argsort(orders, 1)[:, None, :]
        step = np.arange(size[1])[None, :, None]
        takes = np.array([PASS, FAIL, ALL])[choice(rank, step)]
        return contracted(tables, takes.reshape(prod(size), size[1], 2)).reshape(len(tables), *size, len(MEASURES))

    kept = taken(lambda rank, step: np.where(rank <= step, 0, 2))[..., 0]
    removed = taken(lambda rank, step: np.where(rank < step, 0, np.where(rank == step, 1, 2)))
    failing = taken(lambda rank, step: np.where(rank == step, 1, 2))[..., 0]
    alone = taken(lambda rank, step: np.where(rank == step, 1, 0))[..., 0]
    gone = removed[..., 0]
    worth = np.stack([np.where(orders == i, gone, 0).sum((1, 2)) for i in range(len(NAMES))], 1)
    return [kept, gone, failing - gone, alone, removed[..., 1], removed[..., 2], worth[:, orders]]


def interactions(counted: DataFrame) -> DataFrame:
    """One row per part, order and step, from the counts of `cells`."""
    named = ["".join(NAMES[i] for i in o) for o in permutations(range(len(NAMES)))]
    shape = (2,) * len(NAMES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tables = np.zeros((len(frame), *shape, len(MEASURES)), np.int64)
            for p, found in enumerate(frame["cells"]):
                for c in found:
                    # Bit i of the code is axis i.
                    tables[(p, *(c["code"] >> i & 1 for i in range(len(NAMES))))] = [c[m] for m in MEASURES]
            figures = audit(tables)
            steps = len(named) * len(NAMES)
            out = {"part": np.repeat(frame["part"].to_numpy(), steps), "filter_order": np.tile(np.repeat(named, len(NAMES)), len(frame)), "step": np.tile(np.arange(1, len(NAMES) + 1, dtype=np.int32), len(frame) * len(named))}
            names = [f.split()[0] for f in SCHEMA.split(", ")][3:]
            yield pd.DataFrame(out | {k: v.reshape(-1) for k, v in zip(names, figures, strict=True)})

    tables = counted.groupBy("part").agg(F.collect_list(F.struct("code", *MEASURES)).alias("cells"))
    return tables.mapInPandas(run, SCHEMA)
