"""Boxes on nested grids, so that boxes and points meet by equal cells, whatever their sizes.

Level k has cells of side base * 4^k. A box lies on the first level whose cells are at
least as large as it is, where it touches four cells at most. A point, or a box that
looks for larger ones, asks its ancestors, the cells that hold it on each higher
level; only levels that boxes lie on are asked, a table of at most LEVELS + 1 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 20
#: Boxes of a group (a page) that each of its points is held against; where there are more, they meet by cells.
FEW = 32


def side(level: Column, base: float) -> Column:
    return F.lit(base) * F.pow(F.lit(4.0), level)


def cell(c: Column, level: Column, base: float) -> Column:
    return F.floor(c / side(level, base)).cast("long")


def own_level(x0: Column, x1: Column, y0: Column, y1: Column, base: float) -> Column:
    """The level whose cells are at least as large as the box; beyond the last one a box takes as many cells as it needs."""
    size = F.greatest(x1 - x0, y1 - y0) / base
    return F.when(size > 1, F.least(F.lit(LEVELS), F.ceil(F.log2(size) / 2))).otherwise(0).cast("int")


def on_levels(df: DataFrame, first: Column, *dealt: DataFrame) -> DataFrame:
    """A row (_level) for each level from `first` on that any boxes lie on; these are broadcast, LEVELS + 1 rows at most."""
    out = dealt[0].select("_level")
    for d in dealt[1:]:
        out = out.unionByName(d.select("_level"))
    return df.withColumn("_level", F.explode(F.sequence(first, F.lit(LEVELS)))).join(F.broadcast(out.distinct()), "_level", "left_semi")


def spread(df: DataFrame, base: float) -> DataFrame:
    """A row for each cell (_cx, _cy) of its level that a box (_x0, _x1, _y0, _y1) touches."""
    span = lambda a, b: F.explode(F.sequence(cell(F.col(a), F.col("_level"), base), cell(F.col(b), F.col("_level"), base)))
    return df.withColumn("_cx", span("_x0", "_x1")).withColumn("_cy", span("_y0", "_y1"))


def boxed(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, base: float) -> DataFrame:
    """Add the box and its level; rows without a box go."""
    d = df.withColumn("_x0", x0.cast("double")).withColumn("_x1", x1.cast("double")).withColumn("_y0", y0.cast("double")).withColumn("_y1", y1.cast("double"))
    d = d.filter("_x0 <= _x1 AND _y0 <= _y1")
    return d.withColumn("_level", own_level(*(F.col(c) for c in ("_x0", "_x1", "_y0", "_y1")), base))


def points_in_boxes(points: DataFrame, boxes: DataFrame, by: list[str], x: str, y: str, base: float) -> DataFrame:
    """Points (by, x, y, ...) with the boxes (by, ..., of `boxed`) that hold them, borders included.

    Groups of at most FEW boxes meet their points by the group alone, without cells.
    By cells both sides are shuffled: what boxes carry, once a cell, is far more than Spark
    takes it for, so that it would gather a large table in the driver to broadcast it.
    """
    inside = (F.col(x) >= F.col("_x0")) & (F.col(x) <= F.col("_x1")) & (F.col(y) >= F.col("_y0")) & (F.col(y) <= F.col("_y1"))
    marks = ["_x0", "_x1", "_y0", "_y1"]
    if by:
        plain = lambda p, b: p.join(b.drop("_level"), by).filter(inside).drop(*marks)
        crowded = boxes.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FEW).select(*by)
        if crowded.isEmpty():
            return plain(points, boxes)
        few = plain(points.join(crowded, by, "left_anti"), boxes.join(crowded, by, "left_anti"))
        points, boxes = points.join(crowded, by, "left_semi"), boxes.join(crowded, by, "left_semi")
    asked = on_levels(points, F.lit(0), boxes).withColumn("_cx", cell(F.col(x), F.col("_level"), base)).withColumn("_cy", cell(F.col(y), F.col("_level"), base))
    met = asked.join(spread(boxes, base).hint("merge"), [*by, "_level", "_cx", "_cy"]).filter(inside).drop("_level", "_cx", "_cy", *marks)
    return few.unionByName(met) if by else met


def boxes_meeting(left: DataFrame, right: DataFrame, by: list[str], base: float) -> DataFrame:
    """Pairs of rows of two tables of `boxed` whose boxes meet, borders included.

    The smaller box asks the larger one's level. Of the cells that both touch, the one
    with the lower left corner of what they share makes the pair. Other columns must
    differ in name.
    """
    marks = ["_x0", "_x1", "_y0", "_y1"]

    def asking(df: DataFrame, n: str) -> DataFrame:
        d = spread(on_levels(df.withColumnRenamed("_level", "_own"), F.col("_own"), left, right), base)
        return d.select(*[c for c in d.columns if c not in (*marks, "_own")], *[F.col(c).alias(f"{c}_{n}") for c in (*marks, "_own")])

    met = asking(left, "l").join(asking(right, "r"), [*by, "_level", "_cx", "_cy"]).filter("greatest(_own_l, _own_r) = _level")
    low = lambda a: F.greatest(F.col(f"_{a}0_l"), F.col(f"_{a}0_r"))
    high = lambda a: F.least(F.col(f"_{a}1_l"), F.col(f"_{a}1_r"))
    here = (cell(low("x"), F.col("_level"), base) == F.col("_cx")) & (cell(low("y"), F.col("_level"), base) == F.col("_cy"))
    met = met.filter(here & (low("x") <= high("x")) & (low("y") <= high("y")))
    return met.drop("_level", "_cx", "_cy", *[f"{c}_{n}" for c in (*marks, "_own") for n in "lr"])
