"""Pages of few rows meet by the page alone, crowded ones by cells; both ways agree."""

import random

import pytest

from verdigris.operators import joins, spatial


def rows(spark, n):
    rng = random.Random(n)
    at = lambda: float(rng.randrange(300))
    values = [(p if p else None, f"{p}-{i}", at(), at(), rng.choice([0.0, 9.0, 60.0, -4.0, -9.0]), 20.0, rng.choice(["live", "superseded", None])) for p in range(6) for i in range(n)]
    lines = [(p if p else None, f"s{i}", at(), at(), at(), at()) for p in range(6) for i in range(p * n // 8)]
    return spark.createDataFrame(values, "page_id long, id string, x double, y double, w double, h double, status string"), spark.createDataFrame(lines, "page_id long, stroke_id string, x1 double, y1 double, x2 double, y2 double")


def test_strokes_meet_values_by_page(spark, monkeypatch):
    values, strokes = rows(spark, 16)
    found = lambda: sorted(map(str, joins.strikethrough(values, strokes).collect()))
    monkeypatch.setattr(joins, "PAGE_STROKES", 0, raising=False)
    by_cell = found()
    monkeypatch.setattr(joins, "PAGE_STROKES", 5, raising=False)
    assert found() == by_cell and len(by_cell) == 96
    monkeypatch.setattr(joins, "PAGE_STROKES", 64, raising=False)
    monkeypatch.setattr(joins, "boxes_meeting", None)
    assert found() == by_cell


@pytest.mark.parametrize("few", [0, 5, 64])
def test_points_meet_boxes_by_page(spark, monkeypatch, few):
    points, _ = rows(spark, 16)
    grid = [(p, r, c, c * 60.0, c * 60.0 + 60, r * 90.0, r * 90.0 + 90) for p in range(1, 6) for r in range(p) for c in range(2)]
    cells = spark.createDataFrame(grid, "page_id long, row int, col int, x0 double, x1 double, y0 double, y1 double")
    boxes = spatial.boxed(cells, *(joins.F.col(c) for c in ("x0", "x1", "y0", "y1")), joins.CELL)
    monkeypatch.setattr(spatial, "FEW", few, raising=False)
    if few == 64:
        monkeypatch.setattr(spatial, "spread", None)
    got = sorted((r["id"], r["row"], r["col"]) for r in spatial.points_in_boxes(points, boxes, ["page_id"], "x", "y", joins.CELL).collect())
    assert got == sorted((v["id"], g[1], g[2]) for v in points.collect() for g in grid if v["page_id"] == g[0] and g[3] <= v["x"] <= g[4] and g[5] <= v["y"] <= g[6])


def test_dealt_by_rows(spark, monkeypatch):
    """Tasks follow the rows, so that none grows with the table."""
    from verdigris.operators import shared

    monkeypatch.setattr(shared, "DEALT", 10)
    d = shared.dealt(spark.range(1000), "id")
    assert d.rdd.getNumPartitions() >= 100 and d.count() == 1000
