"""Plane geometry on Columns: rings are arrays of struct<x, y>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8


def edges(ring: Column) -> Column:
    """A ring's edges, struct<x1, y1, x2, y2>."""
    return F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def sides(ring: Column) -> Column:
    """A ring's edges with what each point that is held against them would work out again: struct<x1, y1, y2, dx, dy, sq>."""
    run = F.transform(edges(ring), lambda e: F.struct(e["x1"].alias("x1"), e["y1"].alias("y1"), e["y2"].alias("y2"), (e["x2"] - e["x1"]).alias("dx"), (e["y2"] - e["y1"]).alias("dy")))
    return F.transform(run, lambda e: F.struct(e["x1"].alias("x1"), e["y1"].alias("y1"), e["y2"].alias("y2"), e["dx"].alias("dx"), e["dy"].alias("dy"), (e["dx"] * e["dx"] + e["dy"] * e["dy"]).alias("sq")))


def to_ring_distance(ring: Column, x: Column, y: Column) -> Column:
    """Least distance of a point to a ring's edges."""
    return to_sides_distance(sides(ring), x, y)


def to_sides_distance(ring_sides: Column, x: Column, y: Column) -> Column:
    """The same from `sides`; in steps, so that nothing is worked out twice, and with one root, of the least square."""
    along = lambda e: F.when(e["sq"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * e["dx"] + (y - e["y1"]) * e["dy"]) / e["sq"]))).otherwise(0.0)
    at = F.transform(ring_sides, lambda e: F.struct(e.alias("e"), along(e).alias("t")))
    off = F.transform(at, lambda a: F.struct((x - (a["e"]["x1"] + a["t"] * a["e"]["dx"])).alias("x"), (y - (a["e"]["y1"] + a["t"] * a["e"]["dy"])).alias("y")))
    return F.sqrt(F.array_min(F.transform(off, lambda d: d["x"] * d["x"] + d["y"] * d["y"])))


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; what the border is, is left open."""
    return inside_sides(sides(ring), x, y)


def inside_sides(ring_sides: Column, x: Column, y: Column) -> Column:
    crossing = F.filter(ring_sides, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < e["dx"] * (y - e["y1"]) / F.nullif(e["dy"], F.lit(0.0)) + e["x1"]))
    return F.size(crossing) % 2 == 1


def inside_or_on(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule, the border counts."""
    return inside(ring, x, y) | (to_ring_distance(ring, x, y) == 0)


def _side(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def crosses(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether segments ab and cd properly cross."""
    return (_side(ax, ay, bx, by, cx, cy) * _side(ax, ay, bx, by, dx, dy) < 0) & (_side(cx, cy, dx, dy, ax, ay) * _side(cx, cy, dx, dy, bx, by) < 0)


def segment_hits_box(grow: float, segment: Column | None = None) -> Column:
    """Segment (x1, y1)-(x2, y2), columns or a struct's fields, meets the box (x, y, w, h) grown by `grow`: an end inside or a side crossed."""
    box = F.col
    c = F.col if segment is None else segment.getField
    left, top, right, bottom = box("x") - grow, box("y") - grow, box("x") + box("w") + grow, box("y") + box("h") + grow
    within = lambda px, py: (px >= left) & (px <= right) & (py >= top) & (py <= bottom)
    corners = [(left, top), (right, top), (right, bottom), (left, bottom)]
    hit = within(c("x1"), c("y1")) | within(c("x2"), c("y2"))
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        hit = hit | crosses(c("x1"), c("y1"), c("x2"), c("y2"), ax, ay, bx, by)
    return hit


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, from its first vertex, so that far from the origin nothing is lost to rounding."""

    def area(r: Column) -> Column:
        o = F.element_at(r, 1)
        turn = lambda e: (e["x1"] - o["x"]) * (e["y2"] - o["y"]) - (e["x2"] - o["x"]) * (e["y1"] - o["y"])
        return F.abs(F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + turn(e))) / 2

    return once(ring, area)


def to_metres(ring: Column) -> Column:
    """Longitude and latitude in degrees to local metres."""
    lat = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["y"]) / F.size(ring)
    return F.transform(ring, lambda p: F.struct((F.radians(p["x"]) * F.cos(F.radians(lat)) * EARTH_M).alias("x"), (F.radians(p["y"]) * EARTH_M).alias("y")))


def self_crossing(ring: Column) -> Column:
    """Any two edges that are no neighbours cross."""
    numbered = F.transform(edges(ring), lambda e, i: F.struct(e.alias("e"), i.alias("i")))
    n = F.size(ring) - 1
    return once(numbered, lambda all_: F.exists(all_, lambda p: F.exists(all_, lambda q: (q["i"] > p["i"] + 1) & ~((p["i"] == 0) & (q["i"] == n - 1)) & crosses(p["e"]["x1"], p["e"]["y1"], p["e"]["x2"], p["e"]["y2"], q["e"]["x1"], q["e"]["y1"], q["e"]["x2"], q["e"]["y2"]))))


def once(c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c), with c worked out once a row however often `then` names it."""
    return F.element_at(F.transform(F.array(c), then), 1)


def invalid_reason(ring: Column) -> Column:
    """Why a ring is no valid polygon, null if it is one."""
    return once(ring, _reason)


def _reason(ring: Column) -> Column:
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    return (
        F.when(F.size(ring) < 4, "too_few_points")
        .when((first["x"] != last["x"]) | (first["y"] != last["y"]), "not_closed")
        .when(F.size(F.array_distinct(ring)) < 3, "too_few_distinct_vertices")
        .when(self_crossing(ring), "self_intersecting")
        .when(ring_area(ring) == 0, "zero_area")
    )


def polygon_area(ring: Column, crs: Column) -> Column:
    """Square metres as exact decimal text with two places, half up; invalid rings give 0.00."""

    def text(r: Column) -> Column:
        area = F.when(crs == "EPSG:4326", ring_area(to_metres(r))).otherwise(ring_area(r))
        return F.when(_reason(r).isNotNull(), F.lit("0.00")).otherwise(area.cast("decimal(38,2)").cast("string"))

    return once(ring, text)


def clean_vertices(ring: Column, least: float = 1e-6) -> Column:
    """Drop a vertex whose squared distance to the last kept one is below `least`."""

    def step(kept: Column, p: Column) -> Column:
        q = F.try_element_at(kept, F.lit(-1))
        near = F.pow(p["x"] - q["x"], F.lit(2.0)) + F.pow(p["y"] - q["y"], F.lit(2.0)) < least
        return F.when(F.coalesce(near, F.lit(False)), kept).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(ring, F.array().cast("array<struct<x:double,y:double>>"), step)


def affine(x: Column, y: Column, m: Column) -> tuple[Column, Column]:
    """X = ax + by + c, Y = dx + ey + f, rounded to 4 places."""
    return F.round(m["a"] * x + m["b"] * y + m["c"], 4), F.round(m["d"] * x + m["e"] * y + m["f"], 4)


def rotate_back(x: Column, y: Column, degrees: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Undo a rotation about the image's centre."""
    r = F.radians(degrees)
    dx, dy = x - w / 2, y - h / 2
    return F.cos(r) * dx - F.sin(r) * dy + w / 2, F.sin(r) * dx + F.cos(r) * dy + h / 2
