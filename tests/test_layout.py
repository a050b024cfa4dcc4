"""Boxes, bands, labels, gaps and shares against plain loops; large pages and odd identities."""

import random
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import aggs, joins, spatial, workflow

RING = "ring array<struct<x:double,y:double>>"


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


def rects(rng, n, pages=3):
    """Boxes of all sizes, some of no extent, some on cell borders, some negative."""
    out = []
    for i in range(n):
        x, y = (float(rng.choice([0, 64, 128, -64, rng.uniform(-600, 600)])) for _ in range(2))
        w, h = (float(rng.choice([0, 1, 64, 300, 2000, rng.uniform(0, 90)])) for _ in range(2))
        out.append((rng.randrange(pages), i, x, x + w, y, y + h))
    return out


def test_boxes_meet_like_all_pairs(spark):
    rng = random.Random(4)
    left, right = rects(rng, 150), rects(rng, 120)
    cols = "page_id int, {0}id int, {0}a double, {0}b double, {0}c double, {0}d double"
    make = lambda rows, n: spatial.boxed(spark.createDataFrame(rows, cols.format(n)), *(F.col(n + c) for c in "abcd"), 64.0)
    got = spatial.boxes_meeting(make(left, "l"), make(right, "r"), ["page_id"], 64.0).select("page_id", "lid", "rid").collect()
    want = {(p, i, j) for p, i, a, b, c, d in left for q, j, e, f, g, h in right if p == q and max(a, e) <= min(b, f) and max(c, g) <= min(d, h)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_points_meet_boxes_like_all_pairs(spark):
    rng = random.Random(5)
    boxes = rects(rng, 120)
    points = [(rng.randrange(3), k, float(rng.choice([0, 64, -64, rng.uniform(-700, 2700)])), float(rng.choice([0, 64, rng.uniform(-700, 2700)]))) for k in range(300)]
    b = spatial.boxed(spark.createDataFrame(boxes, "page_id int, id int, a double, b double, c double, d double"), *(F.col(c) for c in "abcd"), 64.0)
    p = spark.createDataFrame([*points, (0, 999, None, 1.0)], "page_id int, k int, x double, y double")
    got = spatial.points_in_boxes(p, b, ["page_id"], "x", "y", 64.0).select("k", "id").collect()
    want = {(k, i) for q, k, x, y in points for s, i, a, e, c, d in boxes if q == s and a <= x <= e and c <= y <= d}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_bands_like_all_pairs(spark):
    rng = random.Random(6)
    side = lambda n, pages: [(rng.randrange(pages), i, float(rng.choice([0, 20, 40, rng.randrange(-30, 200)])), rng.randrange(11) / 10) for i in range(n)]
    parcels, owners, shares = side(50, 12), side(60, 14), side(50, 14)
    frame = lambda rows: spark.createDataFrame(rows, "page_id int, id int, y double, confidence double")
    for overlap in (20.0, 0.0):
        got = {(r["page_id"], r["parcel_id"]): (r["owner_ids"], r["share_id"]) for r in joins.bind_rows_by_band(frame(parcels), frame(owners), frame(shares), overlap).collect()}
        want = {}
        for page in {p for p, *_ in parcels}:
            mine = sorted((y, i) for p, i, y, _ in parcels if p == page)
            alone = len(mine) <= 1 and sum(p == page for p, *_ in owners) <= 1
            for k, (y, i) in enumerate(mine):
                end = mine[k + 1][0] if k + 1 < len(mine) else float("inf")
                held = lambda rows: sorted((v, j, c) for p, j, v, c in rows if p == page and (alone or y - overlap <= v < end))  # noqa: B023, E731
                want[page, i] = (",".join(str(j) for _, j, _ in held(owners)), next((j for _, j, _ in held(shares)), None))
        assert got == want


def test_nearest_like_all_pairs(spark):
    rng = random.Random(7)
    owners = [(rng.randrange(5), i, float(rng.randrange(300))) for i in range(120)] + [(0, 500, None)]
    relations = [(rng.randrange(5), i, float(rng.randrange(0, 400, 7))) for i in range(40)] + [(0, 600, None)]
    frame = lambda rows: spark.createDataFrame(rows, "page_id int, id int, y double")
    got = {(r["page_id"], r["id"]): r["relation_id"] for r in joins.nearest_within(frame(owners), frame(relations)).collect()}
    want = {}
    for p, i, y in owners:
        near = [(abs(y - v), j) for q, j, v in relations if q == p and v is not None and y is not None and abs(y - v) < 50]
        if near:
            want[p, i] = min(near)[1]
    assert got == want


def test_a_page_of_100000_boxes(spark):
    """One page; twice the boxes take about twice the time in each of the four joins."""
    t = lambda n: spark.range(n).selectExpr("1 AS page_id", "id", "id AS token_id", "cast(id div 20 * 15 AS double) AS y", "cast(id % 20 * 60 AS double) AS x", "50.0D AS w", "12.0D AS h", "'live' AS status", "0.5D AS confidence", "'t' AS text")
    lines = lambda n: t(n).filter("id % 7 = 0").selectExpr("page_id", "id AS stroke_id", "x AS x1", "y + 5 AS y1", "x + 40 AS x2", "y + 6 AS y2")
    cells = lambda n: spark.range(n // 20).selectExpr("1 AS page_id", "id AS row", "0 AS col", "0.0D AS x0", "1200.0D AS x1", "id * 15.0D AS y0", "id * 15.0D + 15 AS y1")
    runs = {
        "bands": lambda n: joins.bind_rows_by_band(t(n).filter("id % 20 = 0"), t(n).filter("id % 20 = 1"), t(n).filter("id % 20 = 2")),
        "nearest": lambda n: joins.nearest_within(t(n).filter("id % 2 = 0"), t(n).filter("id % 2 = 1")),
        "strikes": lambda n: joins.strikethrough(t(n), lines(n)),
        "cells": lambda n: joins.assign_tokens_to_cells(t(n), cells(n)),
    }
    want = {"bands": 5000, "nearest": 50_000, "strikes": 100_000, "cells": 5000}
    for name, run in runs.items():
        seconds = []
        for n in (50_000, 100_000):
            start = time.time()
            count = run(n).count()
            seconds.append(time.time() - start)
        assert count == want[name]
        assert seconds[1] < 3.5 * seconds[0] + 2, (name, seconds)


def test_labels_of_polygons_with_repeated_ids(spark):
    """Polygon 7 and label 1 are on both pages, other ones each."""
    polygons = spark.createDataFrame([(1, 7, square(0.0, 0.0, 10.0)), (2, 7, square(500.0, 500.0, 10.0)), (3, 7, square(0.0, 0.0, 10.0))], f"page_id int, polygon_id int, {RING}")
    labels = spark.createDataFrame([(1, 1, "A", 5.0, 5.0), (2, 1, "B", 505.0, 505.0), (2, 2, "C", 505.0, 900.0)], "page_id int, label_id int, text string, x double, y double")
    got = sorted(map(tuple, joins.bind_labels(polygons, labels, by=("page_id",)).select("page_id", "polygon_id", "label_id", "text", "status").collect()))
    assert got == [(1, 7, 1, "A", "bound"), (2, 7, 1, "B", "bound"), (3, 7, None, None, "unbound")]


def test_map_lane_of_repeated_ids(spark):
    polygons = spark.createDataFrame([(1, 7, square(0.0, 0.0, 10.0), "EPSG:32643"), (2, 7, square(500.0, 500.0, 20.0), "EPSG:32643"), (3, 7, square(0.0, 0.0, 10.0), "EPSG:32643")], f"page_id int, polygon_id int, {RING}, crs string")
    labels = spark.createDataFrame([(1, 1, "A", 5.0, 5.0), (2, 1, "B", 505.0, 505.0)], "page_id int, label_id int, text string, x double, y double")
    fits = spark.createDataFrame([(p, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.1 if p == 1 else 9.0) for p in (1, 2)], "page_id int, a double, b double, c double, d double, e double, f double, rmse double")
    got = sorted(map(tuple, workflow.map_lane(polygons, labels, fits).select("page_id", "polygon_id", "label_status", "text", "area", "eligible").collect()))
    assert got == [(1, 7, "bound", "A", "100.00", True), (2, 7, "bound", "B", "400.00", False), (3, 7, "unbound", None, "0.00", False)]


def test_labels_of_many_sizes(spark):
    """Polygons from points to the whole plane, on two pages; labels on edges and just beyond `far`."""
    rng = random.Random(9)
    polys = [(rng.randrange(2), i, float(rng.uniform(-900, 900)), float(rng.uniform(-900, 900)), float(rng.choice([0.5, 40, 700, 60_000]))) for i in range(60)]
    points = [(rng.randrange(2), i, f"t{i % 9}", rng.uniform(-1500, 2500), rng.uniform(-1500, 2500)) for i in range(150)]
    got = joins.bind_labels(spark.createDataFrame([(p, i, square(x, y, s)) for p, i, x, y, s in polys], f"page_id int, polygon_id int, {RING}"), spark.createDataFrame(points, "page_id int, label_id int, text string, x double, y double"), by=("page_id",))
    met = {}
    for p, i, x, y, s in polys:
        for q, j, t, a, b in points:
            d = np.hypot(max(x - a, 0, a - x - s), max(y - b, 0, b - y - s))
            if p == q and d <= 50:
                met[p, i, j] = (d, j, t)
    fits = {}
    for p, i, j in met:
        fits.setdefault((p, j), set()).add(i)
    rows = got.collect()
    assert len(rows) == len(polys)
    for r in rows:
        mine = [m for (p, i, _), m in met.items() if (p, i) == (r["page_id"], r["polygon_id"])]
        mine = [m for m in mine if m[0] == 0] or mine
        if not mine:
            assert r["status"] == "unbound"
            continue
        best = min(mine)
        unsure = len({m[2] for m in mine}) > 1 or len(fits[r["page_id"], best[1]]) > 1
        assert (r["label_id"], r["text"], r["status"]) == (best[1], best[2], "ambiguous" if unsure else "bound")


def test_gaps_are_runs(spark):
    rows = [(1, 1), (1, 2_000_000_000), (2, 3), (2, 3), (2, 4), (2, 7), (2, 9), (3, 5), (4, None)]
    df = spark.createDataFrame(rows, "batch_id int, position int")
    got = {r["batch_id"]: ([tuple(g) for g in r["gaps"]], r["state"]) for r in aggs.volume_completeness(df).collect()}
    assert got == {1: ([(2, 1_999_999_999)], "gap_detected"), 2: ([(5, 6), (8, 8)], "gap_detected"), 3: ([], "complete"), 4: ([], "pending")}
    runs = aggs.missing_pages(df.selectExpr("batch_id AS record_id", "position AS page_index"))
    assert sorted(map(tuple, runs.collect())) == [(1, 2, 1_999_999_999), (2, 5, 6), (2, 8, 8)]
    records = df.selectExpr("batch_id AS record_id", "position AS page_index", "0 AS ord", "position AS id", "'f' AS field_name", "'v' AS value")
    lines = {r["record_id"]: r["rationale"] for r in aggs.assemble_records(records).collect()}
    assert lines[1] == "[MISSING_PAGE_GAP] page 2 to 1999999999; [DUPLICATE] f"
    assert lines[2] == "[MISSING_PAGE_GAP] page 5; [MISSING_PAGE_GAP] page 6; [MISSING_PAGE_GAP] page 8; [DUPLICATE] f"


PRIMES = [p for p in range(2, 140) if all(p % q for q in range(2, p))][:34]


@pytest.mark.parametrize("extra", [-1, 0, 1])
def test_shares_of_many_denominators(spark, extra):
    """34 primes as denominators, completed to just one, and a hair to either side."""
    n = Fraction(1) - sum(Fraction(1, 7 * p) for p in PRIMES)
    big = n.denominator
    rows = [(1, "1", str(7 * p)) for p in PRIMES[:10]] + [(2, "1", str(p)) for p in PRIMES] + [(3, "1", "3")] * 3 + [(4, "1", "0")] + [(4, "1", str(p)) for p in PRIMES] + [(6, None, "3"), (6, "1", "1")]
    # Denominators of 11 digits, so that the product has more than 38; halves of one by a pair of each.
    tiny = [(10**10 + 19, 10**10 + 33, 10**10 + 61, 10**10 + 69)]
    for group in tiny:
        for d in group:
            rows += [(5, "1", str(d)), (5, str(d - 1), str(d))]
    rows += [(5, "-3", "1"), (5, str(extra), str(10**10 + 97))]
    df = spark.createDataFrame(rows, "record_id int, n string, d string").selectExpr("record_id", "cast(n AS long) AS n", "cast(d AS long) AS d")
    got = {r["record_id"]: (r["reason_code"], r["verdict"]) for r in aggs.share_sum_validate(df).collect()}
    assert big > 10**38
    assert got[2] == ("SHARE_OVERSUM", "fail") and got[3] == (None, "pass") and got[4] == ("SHARE_UNPARSEABLE", "fail") and got[1] == ("SHARE_UNDERSUM", "pass") and got[6] == (None, "pass")
    assert got[5] == {-1: ("SHARE_UNDERSUM", "pass"), 0: (None, "pass"), 1: ("SHARE_OVERSUM", "fail")}[extra]
