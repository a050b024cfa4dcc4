"""One small test for each finding of round 4 that was right."""

import re

from verdigris.operators.scoring import extract_fields
from verdigris.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_boxes_of_polygons_are_never_gathered_in_the_driver(spark):
    """Spark takes polygons for a small table, whose rings, once a cell, it would broadcast."""
    plan = QUERIES["JOI12_bind_labels"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+Join) \[_level#\w+, _cx#\w+, _cy#\w+\]", plan)
    assert joins and set(joins) == {"SortMergeJoin"}


def test_fields_of_the_text_lane_are_read_once(spark):
    """The search for a field's class stands in the plan of the extraction once, and in none of those that follow."""
    tokens = spark.createDataFrame([(1, "Khasra No. 5", "ror"), (1, " \t", "ror"), (2, None, "ror"), (2, " 7/8 ", "jamabandi")], "page_id long, text string, doc_type string")
    d = extract_fields(tokens)
    searches = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("intakal|dakhil")
    assert searches(d) == 1
    assert sorted(map(tuple, d.select("field_name", "canonical_value").collect())) == [("share_fraction", "7/8"), ("survey_number", "5")]
    assert searches(QUERIES["JOB13_text_lane"](spark, SF)) == 0


def test_candidates_read_a_text_once_for_their_bands(spark):
    """What links pages reads stored numbers, not texts."""
    plan = QUERIES["JOI19_rescan_candidates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "lower(" not in plan
    assert plan.count("array_intersect") == 1  # and each pair is compared once


def test_shingles_of_pages_in_one_call(monkeypatch):
    """Equal runs of words have equal hashes, others don't, wherever pages are cut; a short page is one shingle."""
    import numpy as np
    import pyarrow as pa

    from verdigris.operators import shingles

    pages = [[1, 2, 3, 4], [], [2, 3], [2, 3, 4], [9, 1, 2, 3, 4, 1, 2, 3], [3, 2], [2, 3, 2]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10, 17)), pa.array(pages, pa.list_(pa.int64()))], names=["id", "w"])
    for most in (1, 7, 1000):
        monkeypatch.setattr(shingles, "CALL_WORDS", most)
        got = {}
        for keys, h, many in shingles._pages([batch.slice(0, 3), batch.slice(3)], 3):
            ends = np.cumsum(many)
            got |= {k: h[e - n : e].tolist() for k, e, n in zip(keys.to_pylist(), ends, many, strict=True)}
        runs = {10 + i: [tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))] for i, w in enumerate(pages) if w}
        of = {}
        for k, found in got.items():
            for x, run in zip(found, runs[k], strict=True):
                assert of.setdefault(run, x) == x
        assert got.keys() == runs.keys() and len(set(of.values())) == len(of)


def test_scores_of_pairs_are_rounded_as_in_sql(spark):
    """Of 640 characters 307 differ, which lies between two millionths."""
    import duckdb

    from verdigris.operators import joins

    people = spark.createDataFrame([(1, 1, "a" * 640), (2, 1, "b" * 307 + "a" * 333), (3, 1, "")], "id long, v long, name string")
    got = {(r["a"], r["b"]): r["score"] for r in joins.person_pairs(people, ["v"], "name", 0.9).collect()}
    assert got == {(1, 2): duckdb.sql("select round(1 - 307 / 640, 6)").fetchall()[0][0], (1, 3): 0.0, (2, 3): 0.0}
