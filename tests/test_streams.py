"""Keyed streams over files in shuffled order, with replays, against the batch results; their state after the watermark."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from verdigris.operators import folds
from verdigris.operators import joins as batch_joins
from verdigris.streaming import jobs

T0 = datetime(2024, 3, 1)


def stored(spark, rows, schema, path, files, seed=1):
    """Rows dealt over files at random, so that any file may hold any time; one file a batch is read."""
    order = list(rows)
    random.Random(seed).shuffle(order)
    for k in range(files):
        spark.createDataFrame(order[k::files], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def moments():
    rng = random.Random(7)
    out = [(rng.randrange(5), T0 + timedelta(minutes=rng.randrange(60 * 24 * 4)), i) for i in range(300)]
    # Exactly at the limits of an alert (6 hours) and of a session (1 hour), and just beyond.
    return out + [(9, T0, 900), (9, T0 + timedelta(hours=6), 901), (9, T0 + timedelta(hours=6, microseconds=1), 902), (9, T0 + timedelta(hours=7, microseconds=1), 903), (9, T0 + timedelta(hours=8, microseconds=2), 904)]


def test_alerts_of_shuffled_files(spark, moments, tmp_path):
    rows = [(k, t) for k, t, _ in moments]
    source = stored(spark, rows, "key long, at timestamp", f"{tmp_path}/in", 5)
    stream = jobs.alerts(jobs.ending(source, "at", f"{tmp_path}/run"), late="5 days")
    got = jobs.drained(stream, f"{tmp_path}/run", ends=True).groupBy("key", "opened_us").agg(F.sum("n").alias("n"))
    got = {(r["key"], r["opened"], r["n"]) for r in got.select("key", F.timestamp_micros("opened_us").alias("opened"), "n").collect()}
    batch = folds.novelty_alerts(spark.createDataFrame(moments, "key long, at timestamp, id long"))
    assert got == {tuple(r) for r in batch.select("key", "opened", "n").collect()}
    assert len([g for g in got if g[0] == 9]) == 2


def test_alerts_without_end_wait_for_the_watermark(spark, tmp_path):
    """Rows are counted when the watermark has passed them; later ones wait."""
    hours = [0, 1, 7, 30, 60]
    source = stored(spark, [(1, T0 + timedelta(hours=h)) for h in hours], "key long, at timestamp", f"{tmp_path}/in", 1)
    out = jobs.drained(jobs.alerts(jobs.ending(source, "at", f"{tmp_path}/run"), late="24 hours"), f"{tmp_path}/run")
    assert {(r["opened_us"], r["n"]) for r in out.select("opened_us", "n").collect()} == {(int((T0 + timedelta(hours=h)).timestamp() * 1e6), n) for h, n in ((0, 2), (7, 1), (30, 1))}


def test_state_leaves_after_the_watermark(spark, tmp_path):
    """A stream of many short-lived keys ends with no rows in its state."""
    rows = [(k, T0 + timedelta(hours=k)) for k in range(200)]
    source = stored(spark, rows, "key long, at timestamp", f"{tmp_path}/in", 2)
    sizes = []
    stream = jobs.alerts(jobs.ending(source, "at", f"{tmp_path}/run"), late="10 days")
    jobs.drained(stream, f"{tmp_path}/run")
    for name in ("held", "state"):
        sizes.append(spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/run/checkpoint").count())
    assert sizes[0] > 0
    jobs.drained(stream, f"{tmp_path}/run", ends=True)
    assert [spark.read.format("statestore").option("stateVarName", n).load(f"{tmp_path}/run/checkpoint").count() for n in ("held", "state")] == [0, 0]


def test_cold_start_of_shuffled_files(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(6), T0 + timedelta(minutes=i // 2), i, rng.randrange(7), rng.random() < 0.8, rng.random() < 0.7, rng.random() < 0.1, rng.random() < 0.5) for i in range(400)]
    schema = "scope long, at timestamp, ord long, n int, calibrated boolean, target_met boolean, alert boolean, recovered boolean"
    source = stored(spark, rows, schema, f"{tmp_path}/in", 6)
    out = jobs.drained(jobs.cold_start(jobs.ending(source, "at", f"{tmp_path}/run"), "5 days"), f"{tmp_path}/run", ends=True)
    got = {r["scope"]: r["state"] for r in out.groupBy("scope").agg(F.max_by("state", "_batch").alias("state")).collect()}
    assert got == {r["scope"]: r["state"] for r in folds.cold_start_states(spark.createDataFrame(rows, schema)).collect()}


def test_sessions_at_the_gap(spark, moments, tmp_path):
    rows = [(f"u{k}", t, i) for k, t, i in moments]
    source = stored(spark, rows, "actor string, at timestamp, id long", f"{tmp_path}/in", 4)
    out = jobs.drained(jobs.sessions(jobs.ending(source, "at", f"{tmp_path}/run"), late="5 days"), f"{tmp_path}/run", ends=True)
    got = sorted((r["actor"], r["started_at"], r["n"]) for r in out.collect())
    batch = folds.review_sessions(spark.createDataFrame(rows, "actor string, at timestamp, id long")).groupBy("actor", "session").agg(F.min("at").alias("started_at"), F.count(F.lit(1)).alias("n"))
    assert got == sorted((r["actor"], r["started_at"], r["n"]) for r in batch.collect())
    # 6:00, 6:00 and 7:00 later are one session (just an hour apart), the one after is another.
    assert sorted(n for a, _, n in got if a == "u9") == [1, 1, 3]


def test_decisions_once_in_spite_of_replays(spark, tmp_path):
    rows = [(f"f{i}", ["review", "auto_accept", "bogus", "conflict"][i % 4], i, T0 + timedelta(minutes=i)) for i in range(80)]
    again = [(i, "audit_sample" if o != "bogus" else o, n, t) for i, o, n, t in rows if n % 4 != 2]
    schema = "id string, outcome string, ord long, at timestamp"
    source = stored(spark, rows, schema, f"{tmp_path}/in", 2)
    stream = jobs.decide(jobs.ending(source, "at", f"{tmp_path}/run"), "1 day")
    first = jobs.drained(stream, f"{tmp_path}/run")
    want = sorted((i, o, "error" if o == "bogus" else "decided") for i, o, _, _ in rows)
    assert sorted(map(tuple, first.select("id", "outcome", "status").collect())) == want
    # The same messages again, and others about the same fields: nothing is decided anew.
    for more in (rows, again):
        spark.createDataFrame([r for r in more if r[1] != "bogus"], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, jobs.drained(stream, f"{tmp_path}/run").select("id", "outcome", "status").collect())) == want
    # Also when their state has left: then they are behind the watermark.
    jobs.drained(stream, f"{tmp_path}/run", ends=True)
    assert spark.read.format("statestore").option("stateVarName", "decided").load(f"{tmp_path}/run/checkpoint").count() == 0
    spark.createDataFrame([r for r in rows if r[1] != "bogus"], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, jobs.drained(stream, f"{tmp_path}/run").select("id", "outcome", "status").collect())) == want


def test_a_page_ends_when_all_its_fields_have_come(spark, tmp_path):
    rows, bad = [], {3, 8}
    for page in range(12):
        rows += [(page, f"{page}-{k}", "bogus" if page in bad and k == 1 else "review", T0 + timedelta(hours=page, minutes=k)) for k in range(4 if page != 5 else 3)]
    # Page 0 lacks a field, but one of its others comes three times.
    rows = [r for r in rows if r[1] != "0-2"] + [r for r in rows if r[1] == "0-1"] * 2 + [(99, "99-0", "review", T0)]
    schema = "page_id long, field string, routing_outcome string, at timestamp"
    source = stored(spark, rows, schema, f"{tmp_path}/in", 5)
    want = spark.createDataFrame([(p, 4) for p in range(12)], "page_id long, fields long")
    stream = jobs.page_terminal(jobs.ending(source, "at", f"{tmp_path}/run"), want, "2 days", "3 days")
    done = sorted(r["page_id"] for r in jobs.drained(stream, f"{tmp_path}/run").collect())
    assert done == [p for p in range(12) if p not in {0, 3, 5, 8}]
    spark.createDataFrame([(0, "0-2", "review", T0), (5, "5-3", "conflict", T0), (7, "7-1", "review", T0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(r["page_id"] for r in jobs.drained(stream, f"{tmp_path}/run").collect()) == sorted([*done, 0, 5])
    jobs.drained(stream, f"{tmp_path}/run", ends=True)
    for name in ("fields", "page"):
        assert spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/run/checkpoint").count() == 0


def test_config_join_of_shuffled_files(spark, tmp_path):
    rng = random.Random(11)
    versions = [("s", f"k{rng.randrange(3)}", T0 + timedelta(minutes=10 * rng.randrange(200)), float(i)) for i in range(60)]
    versions = list({(s, k, t): (s, k, t, v) for s, k, t, v in versions}.values())
    asked = [(i, "s", f"k{rng.randrange(4)}", T0 + timedelta(minutes=rng.randrange(2100) - 30)) for i in range(200)]
    asked += [(1000 + i, "s", k, t) for i, (_, k, t, _) in enumerate(versions[:10])]
    v = stored(spark, versions, "scope string, key string, effective_from timestamp, value double", f"{tmp_path}/v", 3)
    r = stored(spark, asked, "request_id long, scope string, key string, at timestamp", f"{tmp_path}/r", 4, seed=2)
    stream = jobs.config_join(jobs.ending(r, "at", f"{tmp_path}/run"), v, "5 days")
    got = jobs.drained(stream, f"{tmp_path}/run", ends=True).select("request_id", "value", "reason_code")
    batch = batch_joins.as_of(spark.createDataFrame(asked, "request_id long, scope string, key string, at timestamp"), spark.createDataFrame(versions, "scope string, key string, effective_from timestamp, value double"), ["scope", "key"], "at", "effective_from", ["value"])
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.select("request_id", "value", "reason_code").collect()))
