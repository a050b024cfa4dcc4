"""Steps that are dealt over tasks, whatever their input comes in."""

from verdigris.plans import QUERIES
from verdigris.sources import files


def test_drop_folder_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """A table in one part is dealt; each name is written once."""
    rows = spark.range(40).selectExpr("concat(id, '.txt') as name", "cast(id as string) as content").coalesce(1)
    dealt, frame = [], type(rows)
    plain = frame.foreachPartition
    monkeypatch.setattr(frame, "foreachPartition", lambda self, f: (dealt.append(self.rdd.getNumPartitions()), plain(self, f))[1])
    files.put_files(rows, f"{tmp_path}/in")
    assert dealt[0] == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert {p.name: p.read_text() for p in (tmp_path / "in").glob("*.txt")} == {f"{i}.txt": str(i) for i in range(40)}


def test_cells_are_expanded_in_bounded_tasks(spark, monkeypatch):
    """One shuffle in all, whose tasks follow the rows."""
    from verdigris.operators import shared

    monkeypatch.setattr(shared, "DEALT", 500)
    d = QUERIES["AGG23_expand_cells"](spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert d.rdd.getNumPartitions() >= 12


def test_labels_are_bound_without_spreading_pairs(spark):
    """No pair is copied for distinct counts; an empty ring is unbound, a text that comes twice is one."""
    from verdigris.operators import joins

    square = lambda x: [(x, 0.0), (x + 10, 0.0), (x + 10, 10.0), (x, 10.0), (x, 0.0)]
    polygons = spark.createDataFrame([(1, square(0.0)), (2, square(500.0)), (3, []), (4, square(900.0))], "polygon_id long, ring array<struct<x:double,y:double>>")
    labels = spark.createDataFrame([(7, "S1", 5.0, 5.0), (8, "S1", 6.0, 5.0), (9, "S2", 530.0, 5.0), (10, "S3", 905.0, 5.0), (11, "S4", 906.0, 5.0)], "label_id long, text string, x double, y double")
    d = joins.bind_labels(polygons, labels)
    assert {r["polygon_id"]: (r["label_id"], r["status"]) for r in d.collect()} == {1: (7, "bound"), 2: (9, "bound"), 3: (None, "unbound"), 4: (10, "ambiguous")}
    assert "Expand" not in d._jdf.queryExecution().executedPlan().toString()
