"""Recall of the neighbour search over many lists of vectors without clusters, and the order of lists."""

import numpy as np
import pytest

from verdigris.llm import ann


@pytest.mark.parametrize(("n", "dim", "list_rows", "centres"), [(12_000, 64, 100, 4096), (10_000, 128, 50, 4096), (12_000, 32, 30, 4096), (9_000, 48, 45, 25)])
def test_recall_over_many_lists(spark, n, dim, list_rows, centres):
    """100 to 400 lists, the last case by two codebooks: at least 0.9 of the true neighbours, worst query included at 0.6."""
    x = np.random.default_rng(n + dim).standard_normal((n, dim))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    asked = np.arange(0, n, 100)
    found: dict[int, list] = {}
    for r in ann.nearest(rows, rows.filter("vec_id % 100 = 0"), 20, list_rows=list_rows, centres=centres).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = []
    for q in asked.tolist():
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(len(set(np.argsort(-score)[:20].tolist()) & set(found[q])) / 20)
        assert len(found[q]) == 20
    assert n // list_rows >= 100 and np.mean(hits) >= 0.9 and min(hits) >= 0.6, (np.mean(hits), min(hits))


@pytest.mark.parametrize("centres", [4096, 50, 12])
def test_ranks_stand_for_the_order(centres):
    """With one codebook, and with two of which some or all coarse cells are ranked list by list."""
    x = np.random.default_rng(2).standard_normal((3000, 16))
    space = ann.Space(x, float(np.sqrt((x * x).sum(1).max())), 300, centres=centres)
    q = space.rotated(x[:20], query=True)
    lists = np.random.default_rng(3).integers(0, space.lists, (20, 15))
    orders = space.order(q, space.lists)
    assert all(sorted(o.tolist()) == list(range(space.lists)) for o in orders)
    assert space.ranks(q, lists).tolist() == [[o.tolist().index(c) for c in row] for o, row in zip(orders, lists.tolist(), strict=True)]


def test_visits_are_not_clipped():
    """Where neighbours stand beyond the first 32 lists, the sample says so."""
    x = np.random.default_rng(4).standard_normal((8000, 96))
    space = ann.Space(x, float(np.sqrt((x * x).sum(1).max())), 160)
    assert ann.visits_for(space, x, 20, 0.96) > 60
    near = np.repeat(np.random.default_rng(5).standard_normal((160, 96)) * 20, 50, 0) + x
    space = ann.Space(near, float(np.sqrt((near * near).sum(1).max())), 160)
    assert ann.visits_for(space, near, 20, 0.96) < 30
