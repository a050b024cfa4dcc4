"""Ordered passes over hot keys, chains in ranges, candidate blocks and person matching, against plain loops."""

import random
import time
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from verdigris.operators import folds, joins, workflow
from verdigris.operators.ordered import Machine, Paths, scan

T0 = datetime(2024, 3, 1)


@pytest.fixture
def many_parts(spark):
    """As on a cluster, ranges stay apart though they are small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(rows, init, step):
    """rows (key, ord, event): the state and reason after each."""
    state, out = {}, []
    for k, o, e in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        to, reason = step(state.get(k, init), e)
        state[k] = state.get(k, init) if reason else to
        out.append((k, o, state[k], reason))
    return sorted(out, key=str)


def events_of(machine, rng, n):
    """A third of all events are of one key, which lies over several ranges; some keys have one event, one key is null."""
    keys = [rng.choice([7, 7, 7, None, *range(100, 140)]) for _ in range(n)]
    if machine == "conflict":
        return [(k, i, (rng.choice(["open", "referred", "resolved", "under_enquiry", "lost", None]), rng.choice([None, "done"]))) for i, k in enumerate(keys)]
    if machine == "rescan":
        return [(k, i, (rng.choice(["assign", "look", "look", "close"]) if rng.random() < 0.1 else "look",)) for i, k in enumerate(keys)]
    return [(k, i, (rng.choice(["claim", "claim", "skip", "submit"]) if i % 50 == 0 else rng.choice(["claim", "skip"]), rng.choice(["u1", "u2", "u3", None]))) for i, k in enumerate(keys)]


CASES = {"conflict": (workflow.conflict_transitions, workflow.conflict_step, "open", "to string, resolution string"), "rescan": (workflow.rescan_lifecycle, workflow.rescan_step, "open", "what string"), "task": (workflow.task_lifecycle, workflow.task_step, "free", "what string, actor string")}


@pytest.mark.parametrize("name", CASES)
def test_machines_over_many_ranges(spark, many_parts, name):
    run, step, init, cols = CASES[name]
    rows = events_of(name, random.Random(len(name)), 3000)
    df = spark.createDataFrame([(k, o, *e) for k, o, e in rows], f"id long, ord long, {cols}").repartition(5)
    got = run(df)
    assert got.rdd.getNumPartitions() == 8
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, init, step)
    assert run(df.limit(0)).count() == 0


def test_a_hot_key_is_linear(spark, many_parts):
    """100,000 events of one key: twice the events take about twice the time, over several tasks."""
    seconds = []
    for n in (50_000, 100_000):
        df = spark.range(n).selectExpr("1L AS id", "id AS ord", "elt(id % 5 + 1, 'resolved', 'under_enquiry', 'referred', 'open', 'lost') AS to", "if(id % 3 = 0, 'done', null) AS resolution")
        start = time.time()
        counts = workflow.conflict_transitions(df).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        seconds.append(time.time() - start)
        assert sum(r["n"] for r in counts) == n and len(counts) > 3
    assert seconds[1] < 4 * seconds[0] + 2


def test_paths_agree_with_single_runs():
    machine = Machine("free", workflow.task_step, lambda e: ("free", "closed", f"by:{e[1]}"))
    rng = random.Random(5)
    for _ in range(200):
        run = [(rng.choice(["claim", "skip", "submit"] if rng.random() < 0.3 else ["claim", "skip"]), f"u{rng.randrange(4)}") for _ in range(rng.randrange(12))]
        paths = Paths(machine)
        for e in run:
            paths.take(e)
        for start in ("free", "closed", "by:u0", "by:u1", "by:u2", "by:u3", "by:someone"):
            now = start
            for e in run:
                to, reason = workflow.task_step(now, e)
                now = now if reason else to
            assert paths.ends().get(start, start) == now


def test_alerts_and_cold_start_of_a_hot_key(spark, many_parts):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 2]), T0 + timedelta(minutes=rng.randrange(9000)), i) for i in range(2000)]
    want = Counter()
    opened = {}
    for k, t, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if k not in opened or t > opened[k] + timedelta(hours=6):
            opened[k] = t
        want[k, opened[k]] += 1
    got = folds.novelty_alerts(spark.createDataFrame(rows, "key long, at timestamp, id long").repartition(4))
    assert {(r["key"], r["opened"]): r["n"] for r in got.collect()} == want
    facts = [(rng.choice([1, 1, 2, 3]), i, rng.choice([None, 1, 3, 5]), rng.random() < 0.9, rng.random() < 0.9, rng.random() < 0.02, rng.random() < 0.3) for i in range(3000)]
    step = folds.cold_start_step(3)
    last = {}
    for k, _, _, _ in plain([(k, o, e) for k, o, *e in facts], "shadow", step):
        last[k] = [r for r in plain([(q, o, e) for q, o, *e in facts if q == k], "shadow", step)]
    final = {k: max(v, key=lambda r: r[1])[2] for k, v in last.items()}
    df = spark.createDataFrame(facts, "scope long, ord long, n int, calibrated boolean, target_met boolean, alert boolean, recovered boolean").repartition(4)
    assert {r["scope"]: r["state"] for r in folds.cold_start_states(df).collect()} == final


def test_scan_of_ties_and_names(spark):
    df = spark.createDataFrame([("a", 1, "y"), ("a", 1, "x"), ("a", 0, "z")], "k string, state long, v string")
    got = scan(df.withColumnRenamed("state", "at"), "k", ["at"], ["v"], Machine("", lambda s, e: (s + e[0], None)))
    assert [r["state"] for r in sorted(got.collect(), key=lambda r: r["state"])] == ["z", "zx", "zxy"]


def entries(n, shards=2):
    return [(i, T0 + timedelta(seconds=i // 3), f"u{i % 3}", "act", str(i), None, None, i % 50 and i % shards) for i in range(n)]


AUDIT = "id long, at timestamp, actor string, action string, subject string, purpose string, value_hash string, shard_id int"


def test_chain_in_ranges(spark, many_parts):
    good = folds.append_chain(spark.createDataFrame(entries(600), AUDIT).repartition(3)).cache()
    rows = {r["id"]: r for r in good.collect()}
    order = defaultdict(list)
    for r in sorted(rows.values(), key=lambda r: (r["shard_id"], r["at"], r["id"])):
        order[r["shard_id"]].append(r["id"])
    assert {(r["shard_id"], r["first_bad"], r["n"]) for r in folds.verify_chain(good).collect()} == {(s, None, len(v)) for s, v in order.items()}
    for i in random.Random(2).sample(sorted(rows), 12):
        shard, follow = rows[i]["shard_id"], order[rows[i]["shard_id"]]
        after = follow[follow.index(i) + 1] if i != follow[-1] else None
        changed = {r["shard_id"]: r["first_bad"] for r in folds.verify_chain(good.withColumn("actor", F.when(F.col("id") == i, "x").otherwise(F.col("actor")))).collect()}
        gone = {r["shard_id"]: r["first_bad"] for r in folds.verify_chain(good.filter(F.col("id") != i)).collect()}
        relinked = {r["shard_id"]: r["first_bad"] for r in folds.verify_chain(good.withColumn("prev_hash", F.when(F.col("id") == i, "00").otherwise(F.col("prev_hash")))).collect()}
        assert changed[shard] == i and gone[shard] == after and relinked[shard] == i
        assert all(v is None for s, v in changed.items() if s != shard)
    lost = good.withColumn("hash", F.when(F.col("id") == order[1][4], F.lit(None)).otherwise(F.col("hash")))
    assert {r["shard_id"]: r["first_bad"] for r in folds.verify_chain(lost).collect()}[1] == order[1][4]
    assert folds.verify_chain(good.limit(0)).count() == 0
    # One shard's entries are looked through in several tasks.
    plan = folds.verify_chain(good)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(shard_id" in plan


def persons_of(rng, n):
    words = ["ram", "Ram lal", "shyam", "sita devi", "sitadevi", "aaaaaaaaaa", "aaaaaaaaab", "aaaa", "mohan das karam", "mohan das karim", "é", "", "x"]
    out = []
    for i in range(n):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(3)):
            p = rng.randrange(len(w) + 1)
            w[p : p + rng.randrange(2)] = rng.choice(["a", "m", "z", ""])
        out.append((i, rng.choice(["v1", "v1", "v2", None]), rng.choice([1, None, 1, 1]), None if rng.random() < 0.05 else "".join(w)))
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75, 0.8, 0.9, 1.0])
def test_persons_equal_all_pairs(spark, threshold):
    rows = persons_of(random.Random(int(threshold * 100)), 220)
    df = spark.createDataFrame(rows, "id long, village string, seg int, name string")
    similar = lambda a, b: a == b or (max(len(a), len(b)) > 0 and round(1 - distance(a, b) / max(len(a), len(b)), 6) >= threshold)
    first, proposed, size = {}, Counter(), Counter((v, s) for _, v, s, _ in rows)
    for i, v, s, n in rows:
        if None not in (v, s, n):
            first.setdefault((v, s, n), i)
    pairs = set()
    for (i, v, s, n), (j, w, t, m) in combinations(rows, 2):
        if None not in (v, s, n, m) and (v, s) == (w, t) and similar(n, m):
            proposed[i] += 1
            proposed[j] += 1
            if n != m:
                pairs.add(tuple(sorted((first[v, s, n], first[v, s, m]))))
    got = joins.match_persons(df, ["village", "seg"], "name", threshold).collect()
    assert {(r["a"], r["b"]) for r in got} == pairs and len(got) == len(pairs)
    each = {r["id"]: (r["representative"], r["proposed"], r["held"]) for r in joins.person_matches(df, ["village", "seg"], "name", threshold).collect()}
    want = {i: (first.get((v, s, n), i), proposed[i], (size[v, s] - 1 - proposed[i]) if None not in (v, s) else 0) for i, v, s, n in rows}
    assert each == want


def test_persons_of_a_hot_block(spark):
    """20,000 names in one block and a name that a third of them have: far fewer than all pairs meet, copies stay a class."""
    df = spark.range(20_000).selectExpr("id", "'v' AS village", "if(id % 3 = 0, 'same name for all', concat('Person#', lpad(pmod(xxhash64(id), 900000000), 9, '0'))) AS name")
    grams = joins.rare_grams(joins.person_classes(df, ["village"], "name"), ["village"], 0.9)
    meeting = grams.select("id", F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    assert meeting < 13_334**2 / 2 / 20
    got = {r["id"]: r for r in joins.person_matches(df, ["village"], "name", 0.9).filter("id % 3 = 0").collect()}
    assert {r["representative"] for r in got.values()} == {0} and {r["proposed"] for r in got.values()} == {6666} and {r["held"] for r in got.values()} == {19_999 - 6666}


def test_persons_within_one_edit_meet_few_others(spark, monkeypatch):
    """5,000 names of one block that differ in digits alone: what meets is about what is proposed, not a share of all pairs."""
    names = [f"Customer#{n:09d}" for n in random.Random(4).sample(range(20_000), 5000)]
    df = spark.createDataFrame([(i, "v", n) for i, n in enumerate(names)], "id long, village string, name string")
    made, real = [], joins.block_pairs
    monkeypatch.setattr(joins, "block_pairs", lambda *a: made.append(real(*a)) or made[-1])
    got = joins.match_persons(df, ["village"], "name", 0.9).count()
    place = set(names)
    assert got == sum(n[:k] + d + n[k + 1 :] in place for n in names for k in range(9, 18) for d in "0123456789" if d > n[k])
    assert sum(d.count() for d in made) < 4 * got


def test_candidates_of_random_records(spark):
    rng = random.Random(6)
    rows = [(i, *(rng.choice([None, "a", "b", "c"]) for _ in range(3)), rng.randrange(4)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, x string, y string, z string, n int")
    passes = {"one": [F.col("x"), F.col("n")], "two": [F.col("y"), F.col("z")], "three": [F.col("x"), F.col("y")]}
    key = lambda r, p: {"one": (r[1], r[4]), "two": (r[2], r[3]), "three": (r[1], r[2])}[p]
    want = {}
    for a, b in combinations(rows, 2):
        found = sorted(p for p in passes if None not in key(a, p) and key(a, p) == key(b, p))
        if found:
            want[a[0], b[0]] = ",".join(found)
    blocks = joins.candidate_blocks(df, passes).cache()
    got = joins.pairs_of(blocks).collect()
    assert {(r["a"], r["b"]): r["passes"] for r in got} == want and len(got) == len(want)
    partners = Counter(i for p in want for i in p)
    assert {r["id"]: r["partners"] for r in joins.candidate_counts(blocks).collect()} == {r[0]: partners[r[0]] for r in rows}
    # All pairs come back from the classes and the pairs between their representatives.
    rep = {r["id"]: r["representative"] for r in blocks.collect()}
    members = defaultdict(list)
    for i, r in rep.items():
        members[r].append(i)
    back = {tuple(sorted((i, j))) for r in joins.class_pairs(blocks).collect() for i in members[r["a"]] for j in members[r["b"]]}
    back |= {p for m in members.values() for p in combinations(sorted(m), 2)}
    assert back == set(want)
    assert joins.candidate_blocks(df.limit(0), passes).count() == 0


def test_a_hot_key_gives_one_row_a_record(spark):
    """50,000 records of one key, each with another one that a few share: linear, where pairs would be 1.25 billion."""
    df = spark.range(50_000).selectExpr("id", "'hot' AS village", "id div 4 AS survey")
    blocks = joins.candidate_blocks(df, {"village": [F.col("village")], "survey": [F.col("village"), F.col("survey")]})
    counts = joins.candidate_counts(blocks).agg(F.count(F.lit(1)), F.min("partners"), F.max("partners"), F.count_distinct("representative")).first()
    assert tuple(counts) == (50_000, 49_999, 49_999, 12_500)
