"""What the findings of round 3 named, each on a few rows against plain loops."""

import random
from collections import defaultdict
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from verdigris.functions import geometry
from verdigris.operators import aggs, joins


@pytest.mark.parametrize("n", [0, 1, 400])
def test_pass_counts_make_no_pair(spark, n, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b"]), rng.choice([1, 2, 3, None]), rng.randrange(5), rng.randrange(60)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, village string, survey int, khata int, cell int")
    passes = {c: [F.col("village"), F.col(c)] for c in ("survey", "khata", "cell")}
    met = defaultdict(int)
    for x, y in combinations(rows, 2):
        both = [c for c, k in (("cell", 4), ("khata", 3), ("survey", 2)) if x[1] == y[1] and x[k] is not None and x[k] == y[k]]
        if both:
            met[",".join(both)] += 1
    monkeypatch.setattr(joins, "block_pairs", None)
    counts = joins.pass_counts(joins.candidate_blocks(df, passes))
    assert {r["passes"]: r["n"] for r in counts.collect()} == met
    found, true = (sum(v for k, v in met.items() if c in k) for c in (",", "survey"))
    got = aggs.counted_quality(counts, F.col("passes").contains(","), F.col("passes").contains("survey")).first()
    both = sum(v for k, v in met.items() if "," in k and "survey" in k)
    assert tuple(got) == ((round(both / found, 6), round(both / true, 6)) if n > 1 else (None, None))


def test_hot_key_of_pass_counts(spark):
    """100,000 records of one key are five billion pairs."""
    df = spark.range(100_000).select("id", F.lit("v").alias("village"), (F.col("id") % 1000).alias("khata"))
    counts = joins.pass_counts(joins.candidate_blocks(df, {"khata": [F.col("village"), F.col("khata")], "owner": [F.col("village")]}))
    both = 1000 * 100 * 99 // 2
    assert {r["passes"]: r["n"] for r in counts.collect()} == {"khata,owner": both, "owner": 100_000 * 99_999 // 2 - both}


def test_area_far_from_the_origin(spark):
    """A square of side 3 a long way off, and the SQL of SCA16 beyond the pole, where the cosine changes its sign."""
    import __spark_entry__ as entry

    x = 1e9
    ring = F.array(*[F.struct(F.lit(x + a).alias("x"), F.lit(x + b).alias("y")) for a, b in ((0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0), (0.0, 0.0))])
    assert spark.range(1).select(geometry.ring_area(ring).alias("a")).first()["a"] == 9.0
    duck = duckdb.connect()
    duck.sql("create table part as select 60001 + 2 * i as p_partkey, 10 + i % 5 as p_size from range(3000) r(i)")
    assert duck.sql(f"select min(kilo) from ({entry.oracle_sql()['SCA16_geographic_area']})").fetchall()[0][0] >= 0


def test_state_is_kept_by_bucket(spark, tmp_path, monkeypatch):
    """5000 keys, some null, are a few texts in a few buckets, and decided once each."""
    from datetime import datetime, timedelta

    from verdigris.streaming import jobs, keyed

    monkeypatch.setattr(keyed, "BUCKETS", 4)
    monkeypatch.setattr(keyed, "CHUNK", 400)
    t0 = datetime(2024, 3, 1)
    rows = [(f"f{i}" if i else None, ["review", "bogus"][i % 2], i, t0 + timedelta(minutes=i)) for i in range(5000)]
    schema = "id string, outcome string, ord long, at timestamp"
    for _ in range(2):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = jobs.drained(jobs.decide(jobs.ending(source, "at", f"{tmp_path}/run"), "9 days"), f"{tmp_path}/run").select("id", "outcome", "status")
    want = [(i, o, "error" if o == "bogus" else "decided") for i, o, _, _ in rows]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want + [w for w in want if w[2] == "error"]))
    assert spark.read.format("statestore").option("stateVarName", "decided").load(f"{tmp_path}/run/checkpoint").count() <= 4


def test_all_pairs_of_persons_are_scored(spark):
    """Held pairs are rows as well; a missing name is held, a missing block has no pairs."""
    rows = [(1, 7, "s", "anna"), (2, 7, "s", "anne"), (3, 7, "s", "anna"), (4, 7, "s", None), (5, 7, "t", "anna"), (6, None, "s", "anna"), (7, 7, "s", ""), (8, 7, "s", "")]
    df = spark.createDataFrame(rows, "id long, village int, seg string, name string")
    got = {(r["a"], r["b"]): (r["score"], r["decision"]) for r in joins.person_pairs(df, ["village", "seg"], "name", 0.9).collect()}
    assert set(got) == set(combinations([1, 2, 3, 4, 7, 8], 2))
    assert got[1, 3] == (1.0, "propose") and got[1, 2] == (0.75, "hold") and got[1, 4] == (None, "hold") and got[7, 8] == (None, "hold")


def test_extractor_yields_few_tokens_at_once(spark, monkeypatch):
    """A batch of long pages is never held as one frame of tokens."""
    from verdigris.operators import plugins

    sizes = []
    frames = [plugins.pd.DataFrame({"page_id": [1, 2, None], "html": ["a b c d e", "f g h i", None]})]

    class Pages:
        schema = {"page_id": type("Field", (), {"dataType": type("Long", (), {"simpleString": lambda self: "bigint"})()})}

        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            sizes.extend(list(f["text"]) for f in run(iter(frames)))

    monkeypatch.setattr(plugins, "TOKENS", 4, raising=False)
    plugins.extract_with(Pages(), lambda x: [(w, 1.0) for w in x.split()], "html", "page_id")
    assert sizes == [["a", "b", "c", "d"], ["e", "f", "g", "h"], ["i"]]


def test_a_ring_is_worked_out_once(spark):
    """However often the rules name a ring, its expression stands in them once."""
    ring = F.col("a_ring_of_some_work")
    for c in (geometry.invalid_reason(ring), geometry.ring_area(ring), geometry.polygon_area(ring, F.lit("EPSG:4326"))):
        assert str(c).count("a_ring_of_some_work") == 1


def test_next_band_puts_a_missing_id_last(spark):
    """As the SQL of WIN13 has it, where nulls come last."""
    from verdigris.operators import folds

    rows = [(1, None, 0.0, 20.0), (1, 3, 0.0, 20.0), (1, 4, 50.0, 20.0)]
    got = {r["id"]: r["next_center"] for r in folds.next_band(spark.createDataFrame(rows, "page_id long, id long, y double, h double")).collect()}
    assert got == {3: 10.0, None: 60.0, 4: float("inf")}
