"""Places where users bring their own functions."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateChecks:
    """Publish checks: each maps subjects to (subject, reason) rows; all of them run."""

    def __init__(self) -> None:
        self.checks: list[Callable[[DataFrame], DataFrame]] = []

    def register(self, check: Callable[[DataFrame], DataFrame]) -> None:
        self.checks.append(check)

    def evaluate(self, subjects: DataFrame) -> DataFrame:
        """Blocked subjects with all their reasons, in the order of registration."""
        out = None
        for k, check in enumerate(self.checks):
            rows = check(subjects).select("subject", F.struct(F.lit(k).alias("k"), F.col("reason").alias("reason")).alias("r"))
            out = rows if out is None else out.unionByName(rows)
        return out.groupBy("subject").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["reason"]), ";").alias("reasons"))


def apply_calibrator(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str]) -> DataFrame:
    """A user's model in Arrow batches: fn gives a frame with `probability` and `attributions` (dict) for each row."""

    @F.pandas_udf("probability double, attributions map<string,double>")
    def run(features: pd.DataFrame) -> pd.DataFrame:
        return fn(features)

    return df.withColumn("_c", run(F.struct(*columns))).select(*df.columns, "_c.probability", "_c.attributions")


def apply_novelty(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str]) -> DataFrame:
    """A user's novelty model: fn gives score, outside, reason and cluster for each row."""

    @F.pandas_udf("score double, outside boolean, reason string, cluster string")
    def run(features: pd.DataFrame) -> pd.DataFrame:
        return fn(features)

    return df.withColumn("_n", run(F.struct(*columns))).select(*df.columns, "_n.*")


def select_audit(df: DataFrame, selector: Callable[[Column], Column], key: str = "id") -> DataFrame:
    """A user's audit selector as a Column function of the field's id."""
    return df.withColumn("selected", selector(F.col(key)))


#: Token rows that a task holds at once.
TOKENS = 20_000


def extract_with(pages: DataFrame, reader: Callable[[str], list[tuple[str, float]]], content: str, key: str) -> DataFrame:
    """A user's reader of page content: token rows (key, position, text, confidence); map pages give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((k, i, t, c) for b in batches for k, x in zip(b[key], b[content], strict=True) for i, (t, c) in enumerate(reader(x or "")))
        while some := list(itertools.islice(rows, TOKENS)):
            yield pd.DataFrame(some, columns=[key, "position", "text", "confidence"])

    return pages.select(key, content).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, position long, text string, confidence double")
