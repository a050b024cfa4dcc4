"""Boundary rows and brute force for what SQL does not cover."""

import datetime as dt
import hashlib
import hmac
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.functions import geometry as G
from verdigris.functions import text as T
from verdigris.functions.hashing import hmac_hash, shard_for, shard_key
from verdigris.operators import aggs, folds, joins, plugins, projections, sampling, scoring, workflow
from verdigris.sources import files
from verdigris.streaming import jobs


def test_scan_batch_files(spark, tmp_path):
    cases = {"a.pdf": {"district": "X"}, "b.txt": {"district": "X"}, "c.png": {"district": "  "}, "d.bin": {"district": "X", "mime": "image/tiff"}, "e.jpg": None, "f.jpg": "no json", "g.jpg": "[1]"}
    for name, meta in cases.items():
        (tmp_path / name).write_bytes(b"x")
        if meta is not None:
            (tmp_path / f"{name}.meta.json").write_text(meta if isinstance(meta, str) else json.dumps(meta))
    got = {r["path"].rsplit("/", 1)[1]: r["reason_code"] for r in files.scan_batch_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": None, "b.txt": "unsupported_mime_type", "c.png": "missing_mandatory_field:district", "d.bin": None, "e.jpg": "missing_batch_metadata", "f.jpg": "invalid_batch_metadata", "g.jpg": "invalid_batch_metadata"}


def test_stream_batch_files_handles_each_once(spark, tmp_path):
    drop, out = tmp_path / "drop", tmp_path / "out"
    drop.mkdir()
    write = lambda n, m: (drop / f"{n}.meta.json").write_text(json.dumps(m))
    write("a.pdf", {"district": "X", "mime": "application/pdf"})
    jobs.batch_files(spark, str(drop), str(out))
    write("b.pdf", {"district": None, "mime": "application/pdf"})
    jobs.batch_files(spark, str(drop), str(out))
    jobs.batch_files(spark, str(drop), str(out))
    assert spark.read.parquet(f"{out}/accepted").count() == 1
    assert [r["reason_code"] for r in spark.read.parquet(f"{out}/rejected").collect()] == ["missing_mandatory_field:district"]


def test_publish_sink_writes_and_receipts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, target string")
    got = {r["id"]: r["reference"] for r in files.publish_sink(df, str(tmp_path / "p"), "id", "target").collect()}
    assert got == {1: "a-1", 2: "b-1", 3: "a-2"}
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_hashes(spark):
    rows = spark.createDataFrame([("é", "d1"), ("", None)], "v string, d string")
    for key in (b"k", b"long" * 40):
        got = [r[0] for r in rows.select(hmac_hash(F.col("v"), key)).collect()]
        assert got == [hmac.new(key, v.encode(), "sha256").hexdigest() for v in ("é", "")]
    got = [r[0] for r in rows.select(shard_for(shard_key(F.col("d"), F.lit(None).cast("string")))).collect()]
    assert got == [int(hashlib.sha256(b"district:d1").hexdigest(), 16) % 8, 0]


ENTRY = "id long, at timestamp, actor string, action string, subject string, purpose string, value_hash string, shard_id int"


def entries(spark):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i // 3, 0, 0 if i % 2 else 120), f"u{i % 3}", "a", str(i), None if i % 2 else "p", None, i % 2) for i in range(20)]
    return spark.createDataFrame(rows, ENTRY), rows


def test_chain_equals_python_and_tampering_is_found(spark):
    df, rows = entries(spark)
    chain = folds.append_chain(df)
    want, prev = {}, {}
    for i, at, *rest, shard in sorted(rows, key=lambda r: (r[1], r[0])):
        at = at.replace(tzinfo=dt.UTC)
        h = hashlib.sha256("|".join([prev.get(shard) or "", *[x or "" for x in rest], at.isoformat()]).encode()).hexdigest()
        want[i], prev[shard] = h, h
    assert {r["id"]: r["hash"] for r in chain.collect()} == want
    assert all(r["first_bad"] is None for r in folds.verify_chain(chain).collect())
    bad = chain.withColumn("actor", F.when(F.col("id") == 8, "x").otherwise(F.col("actor")))
    assert {r["shard_id"]: r["first_bad"] for r in folds.verify_chain(bad).collect()} == {0: 8, 1: None}
    gone = {r["shard_id"]: r["first_bad"] for r in folds.verify_chain(chain.filter("id <> 9")).collect()}
    assert gone == {0: None, 1: 11}
    more = folds.append_chain(df.withColumn("id", F.col("id") + 100), aggs.shard_heads(spark, chain))
    assert more.filter("id IN (100, 101) AND prev_hash IS NULL").count() == 0


def test_merkle_root_of_odd_levels(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for n in (0, 1, 2, 3, 5, 8):
        level = [sha(f"{i}:h{i}") for i in range(n)]
        while len(level) > 1:
            level = [sha(level[i] + (level[i + 1] if i + 1 < len(level) else level[i])) for i in range(0, len(level), 2)]
        df = spark.createDataFrame([(i, f"h{i}") for i in range(n)], "shard_id int, head string")
        assert aggs.merkle_root(df).first()["root"] == (level[0] if n else sha(""))


def test_sessions_split_over_the_gap_only(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "a", t), (2, "a", t + dt.timedelta(hours=1)), (3, "a", t + dt.timedelta(hours=2, seconds=1))]
    got = [(r["session"], r["hour_into_session"]) for r in folds.review_sessions(spark.createDataFrame(rows, "id long, actor string, at timestamp")).orderBy("id").collect()]
    assert got == [(0, 0), (0, 1), (1, 0)]


def test_alert_window_is_anchored(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("k", t + dt.timedelta(hours=h), h) for h in (0, 5, 6, 7, 13)]
    got = [(r["opened"].hour, r["n"]) for r in folds.novelty_alerts(spark.createDataFrame(rows, "key string, at timestamp, id long")).orderBy("opened").collect()]
    assert got == [(0, 3), (7, 2)]


def test_cold_start_state_table(spark):
    for state in jobs.NEXT:
        for bits in range(32):
            flags = [bool(bits >> k & 1) for k in range(5)]
            n = 3 if flags[0] else 2
            new = jobs.next_state(state, n, *flags[1:])
            assert new in jobs.NEXT and (new != "regression" or state == "regression" or flags[3])
    e = spark.createDataFrame([("s", i, 3, True, True, i == 3, i == 4) for i in range(5)], "scope string, ord int, n int, calibrated boolean, target_met boolean, alert boolean, recovered boolean")
    assert folds.cold_start_states(e).first()["state"] == "ramp"
    assert folds.cold_start_states(e.filter("ord < 4")).first()["state"] == "regression"
    assert folds.cold_start_states(e.filter("ord < 3")).first()["state"] == "steady"


def test_routing_thresholds(spark):
    rows = [(0.05, False, False, "steady", False), (0.0499, False, False, "steady", False), (0.9, True, True, "steady", True), (0.9, False, True, "steady", True), (0.9, False, False, "ramp", True), (0.9, False, False, "steady", True)]
    df = spark.createDataFrame(rows, "confidence double, outside boolean, conflict boolean, state string, sampled boolean")
    got = [r["outcome"] for r in scoring.route_fields(df, 0.95).collect()]
    assert got[1:] == ["review", "outside_calibrated_regime", "conflict", "review", "audit_sample"] and got[0] in ("auto_accept", "review")


def test_novelty_limit_is_inside(spark):
    df = spark.createDataFrame([(1, "s", [0.5]), (2, "s", [0.51]), (3, "t", [0.0]), (4, "s", [0.0, 0.0])], "id long, stratum string, embedding array<double>")
    proto = spark.createDataFrame([("s", [0.0])], "stratum string, prototype array<double>")
    got = {r["id"]: (r["outside"], r["reason_code"]) for r in scoring.novelty(df, proto).collect()}
    assert got[1] == (False, None) and got[2][0] and got[3] == (True, "unseen_stratum") and got[4][1] == "dimension_mismatch"


def test_training_equals_plain_descent(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (60, 2)).astype(float)
    y = (x.sum(1) + rng.normal(size=60) > 2).astype(float)
    df = spark.createDataFrame([("a" if i < 40 else "b", [float(v) for v in x[i]], float(y[i])) for i in range(60)], "stratum string, x array<double>, y double")
    got = {r["stratum"]: (r["w"], r["b"]) for r in scoring.train_calibrators(df, 30).collect()}
    assert set(got) == {"a", "*"}
    for name, rows in (("a", slice(0, 40)), ("*", slice(0, 60))):
        w, b = scoring.descend(x[rows], y[rows], np.ones(len(x[rows])))
        assert np.allclose(got[name][0], w) and got[name][1] == pytest.approx(b)
    assert scoring.apply_calibrator(df.withColumn("token_confidence", F.lit(1.0)), df.sparkSession.createDataFrame([], "stratum string, w array<double>, b double"), None).first()["confidence"] == pytest.approx(0.98)


def test_rescan_pairs_equal_jaccard(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {}
    for r in docs.orderBy("doc_id").collect():
        w = r["text"].lower().split()
        s = frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
        sets.setdefault(s, r["doc_id"])
    rep = {r["doc_id"]: sets[frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))] for r in docs.collect() for w in [r["text"].lower().split()]}
    ids = sorted((d, s) for s, d in sets.items())
    want = {d: set() for d in sets.values()}
    for i, (a, s) in enumerate(ids):
        for b, t in ids[i + 1 :]:
            if len(s & t) >= 0.8 * len(s | t):
                want[a].add(b)
                want[b].add(a)
    for r in joins.rescan_candidates(docs).collect():
        found = {int(p.split(":")[0]) for p in r["partners"].split(",") if p}
        assert (r["representative"], r["links"], found) == (rep[r["doc_id"]], len(want[rep[r["doc_id"]]]), want[rep[r["doc_id"]]])


def test_block_pairs_of_a_hot_block(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 7)
    rows = [(i, "hot" if i < 60 else f"k{i % 5}") for i in range(90)]
    df = spark.createDataFrame(rows, "id long, k string")
    got = [(r["a"], r["b"]) for r in joins.block_pairs(df, ["k"], []).collect()]
    want = {(a, b) for a, ka in rows for b, kb in rows if a < b and ka == kb}
    assert len(got) == len(want) and set(got) == want


def test_merkle_root_of_any_number_of_leaves(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for n in (0, 1, 2, 3, 8, 9, 16, 17, 33):
        level = [sha(str(i)) for i in range(n)]
        got = spark.createDataFrame([(level,)], "v array<string>").select(aggs.root_of(F.col("v"))).first()[0]
        while len(level) > 1:
            level = [sha(level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
        assert got == (level[0] if level else sha(""))


def test_wide_polygons_bind_like_brute_force(spark):
    rng = np.random.default_rng(2)
    boxes = [(i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(zip(rng.uniform(-900, 900, 40), rng.uniform(-900, 900, 40), rng.choice([3, 40, 700, 5000], 40), strict=True))]
    points = [(100 + i, f"t{i % 9}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-1500, 6000, (60, 2)))]
    ring = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    polygons = spark.createDataFrame([(i, ring(x, y, s)) for i, x, y, s in boxes], "polygon_id int, ring array<struct<x:double,y:double>>")
    labels = spark.createDataFrame(points, "label_id int, text string, x double, y double")
    met = {}
    for i, x, y, s in boxes:
        for j, t, px, py in points:
            d = math.hypot(max(x - px, 0, px - x - s), max(y - py, 0, py - y - s))
            if d <= 50:
                met[i, j] = (d, j, t)
    fits = {}
    for i, j in met:
        fits.setdefault(j, set()).add(i)
    for r in joins.bind_labels(polygons, labels).collect():
        mine = [m for (i, _), m in met.items() if i == r["polygon_id"]]
        mine = [m for m in mine if m[0] == 0] or mine
        if not mine:
            assert r["status"] == "unbound"
            continue
        best = min(mine)
        unsure = len({m[2] for m in mine}) > 1 or len(fits[best[1]]) > 1
        assert (r["label_id"], r["text"], r["status"]) == (best[1], best[2], "ambiguous" if unsure else "bound")


def brute_cross(p, q, r, s):
    side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    return side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0


def test_strikethrough(spark):
    values = spark.createDataFrame([(1, f"v{i}", 0.0, 20.0 * i, 40.0, 10.0, s) for i, s in enumerate(["live", "superseded", "unknown", "live"])], "page_id long, id string, x double, y double, w double, h double, status string")
    strokes = spark.createDataFrame([(1, "s0", -5.0, 5.0, 60.0, 6.0), (1, "s1", 5.0, 22.0, 9.0, 23.0), (1, "s2", 0.0, 53.0, 40.0, 53.0), (2, "s3", 0.0, 5.0, 9.0, 5.0)], "page_id long, stroke_id string, x1 double, y1 double, x2 double, y2 double")
    got = {r["id"]: (r["status"], r["ambiguous"], r["strokes"]) for r in joins.strikethrough(values, strokes).collect()}
    assert got == {"v0": ("cancelled", False, "s0"), "v1": ("superseded", False, "s1"), "v2": ("unknown", True, "s2"), "v3": ("live", False, "")}


def test_rings(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    bow = [square[0], square[2], square[1], square[3], square[0]]
    rows = [(1, square), (2, bow), (3, square[:4]), (4, square[:3]), (5, [(0.0, 0.0)] * 5), (6, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)])]
    df = spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>")
    got = {r["id"]: r["reason"] for r in df.select("id", G.invalid_reason(F.col("ring")).alias("reason")).collect()}
    assert got == {1: None, 2: "self_intersecting", 3: "not_closed", 4: "too_few_points", 5: "too_few_distinct_vertices", 6: "zero_area"}
    assert brute_cross((0, 0), (2, 2), (2, 0), (0, 2))
    inside = df.filter("id = 1").select(*[G.inside_or_on(F.col("ring"), F.lit(x), F.lit(y)).alias(n) for n, x, y in (("in", 1.0, 1.0), ("edge", 2.0, 1.0), ("corner", 0.0, 0.0), ("out", 2.1, 1.0))]).first()
    assert tuple(inside) == (True, True, True, False)
    far = df.filter("id = 1").select(G.to_ring_distance(F.col("ring"), F.lit(5.0), F.lit(6.0))).first()[0]
    assert far == pytest.approx(5.0)
    x, y = G.rotate_back(F.lit(10.0), F.lit(5.0), F.lit(90.0), F.lit(10.0), F.lit(10.0))
    assert [round(v, 6) for v in spark.range(1).select(x, y).first()] == [5.0, 10.0]


def test_canonical_values(spark):
    cases = [
        ("survey_number", "Khasra No 123/4", "123/4"), ("survey_number", "survey num 12A/3-b", "12A/3-b"), ("survey_number", "PLOT # 7", "7"), ("survey_number", "gata 9", "9"), ("survey_number", "Khasra No. 12 / 3", "12"), ("survey_number", " no  number ", "no number"),
        ("khata_number", "Khata No 56", "56"), ("khata_number", "khatauni no.56/a", "56/a"), ("khata_number", "Account #77", "77"), ("khata_number", "khewat 5", "khewat 5"),
        ("share_fraction", "Share: 1/2 of 3/4", "1/2"), ("share_fraction", "1 / 2", "1 / 2"),
        ("area", "Area: 1.25 Hectare", "1.25 hectare"), ("area", "3 owners", "3 owners"), ("area", "2 Bigha 3 biswa", "2 bigha"), ("area", "40 SQ. M", "40 sq. m"), ("area", "7 square meters", "7 square meters"), ("area", "5 ha", "5 ha"), ("area", "1acre", "1acre"),
        ("mutation_reference", "Mutation No 405", "405"), ("mutation_reference", "intakal ref 12/B", "12/B"), ("mutation_reference", "order # 9-1", "9-1"),
        ("date", "dated 05/06/1987", "1987-06-05"), ("date", "1987.06.05", "1987-06-05"), ("date", "5/6/1987", "5/6/1987"), ("date", "on 05-06-1987 or 1990-01-02", "1987-06-05"),
        ("owner_name", "  Shri   Ram ", "Shri Ram"), ("owner_name", "", None), ("owner_name", None, None), ("survey_number", "  ", ""),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, field string, t string, want string")
    got = df.select("i", T.canonical_value(F.col("field"), F.col("t")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [c[2] for c in cases]


def test_field_classes(spark):
    by_word = {
        "mutation_reference": ["Mutation 5", "intakal", "Dakhil  Kharij", "order ref 1"],
        "date": ["Date:", "dated", "scanning date", "on 01/02/1999", "01.02.1999"],
        "relationship": ["Ram s/o Shyam", "w/o", "D/O x", "c/o y", "son of z", "wife  of", "daughter of", "care of", "late Ram"],
        "survey_number": ["khasra 5", "Survey", "plot 7", "gata"],
        "khata_number": ["khatauni", "khata 9", "account 4", "khewat"],
        "area": ["area", "1 hectare", "2 ha", "3 acre", "bigha", "biswa", "sq m", "sqm", "square meter"],
        "land_classification": ["classification", "land type", "chahi", "barani", "irrigated", "unirrigated", "abadi", "agricultural"],
        "share_fraction": ["share", "hissa 1/2", "fraction"],
        "owner_name": ["owner", "khatedar", "pattadar", "landowner", "nam", "name", "Shri Ram", "smt"],
        "text_line": ["", None, "haha", "planet", "updated", "5 6", "12/", "1/2/3"],
    }
    first = [("mutation dated 01/02/1999", "mutation_reference"), ("date of khata", "date"), ("late owner of plot 5", "relationship"), ("khasra khata", "survey_number"), ("khata area", "khata_number"), ("area share", "area"), ("abadi share", "land_classification"), ("share of owner", "share_fraction")]
    bare = [("12/34", "ror", "survey_number"), ("12/34", "khasra_khatauni", "survey_number"), ("12/34", "jamabandi", "share_fraction"), ("12/34", "deed", "text_line"), ("12/34", None, "text_line"), (" 7 ", "jamabandi", "khata_number"), ("7", "ror", "text_line"), ("7", "mutation_register", "text_line"), ("7", None, "text_line"), ("१२/३", "ror", "survey_number")]
    cases = [(t, "unknown", f) for f, ts in by_word.items() for t in ts] + [(t, "ror", f) for t, f in first] + bare
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, doc string, want string")
    got = df.select("i", T.classify_field(F.col("t"), F.col("doc")).alias("f")).orderBy("i").collect()
    assert [(c[0], c[1], r["f"]) for c, r in zip(cases, got, strict=True)] == cases


def test_text_rules(spark):
    rows = [("  Khasra  No. 12 / 3 ",), (" सर्वे  12",), ("   ",), (None,), ("",), ("3/04",), ("3/0",), ("1234567890/2 and 1/3",), ("1/99999999999999999999",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(T.normalize_text(F.col("t"))).collect()] == ["Khasra No. 12 / 3", "सर्वे 12", "", None, None, "3/04", "3/0", "1234567890/2 and 1/3", "1/99999999999999999999"]
    assert [r[0] for r in df.select(T.unconstrained_value(F.col("t"))).collect()][:5] == ["Khasra  No. 12 / 3", "सर्वे  12", "", None, None]
    assert [tuple(r[0]) for r in df.select(T.parse_fraction(F.col("t"))).collect()] == [(None, None)] * 5 + [(3, 4), (None, None), (1234567890, 2), (None, None)]
    two = spark.createDataFrame([("कखग", "कघग"), (None, "ab")], "a string, b string")
    assert [r[0] for r in two.select(T.edit_distance(F.col("a"), F.col("b"))).collect()] == [1, 2]


def test_masking_moves_together(spark):
    df = spark.createDataFrame([("owner_name", "A", None, "c"), ("area", "1", "1", "c")], "field_name string, value string, raw_value string, crop_uri string")
    got = [tuple(r) for r in projections.mask(df, "viewer").collect()]
    assert got == [("owner_name", "•••", None, None, True), ("area", "1", "1", "c", False)]
    assert [r["masked"] for r in projections.mask(df, projections.UNMASKED_ROLE).collect()] == [False, False]


def test_ranks_are_global(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert {r["v"]: r["n"] for r in sampling.ranks(df, ["v"], "n").collect()} == {i: i + 1 for i in range(1000)}


def test_share_sums_are_exact(spark):
    rows = [(1, 1, 3), (1, 1, 3), (1, 1, 3), (2, 1, 3), (2, 1, 3), (3, 2, 3), (3, 1, 2), (4, 1, 0)]
    got = {r["record_id"]: (r["reason_code"], r["verdict"]) for r in aggs.share_sum_validate(spark.createDataFrame(rows, "record_id long, n long, d long")).collect()}
    assert got == {1: (None, "pass"), 2: ("SHARE_UNDERSUM", "pass"), 3: ("SHARE_OVERSUM", "fail"), 4: ("SHARE_UNPARSEABLE", "fail")}


def test_affine_fit_equals_numpy(spark):
    rng = np.random.default_rng(1)
    p = rng.random((12, 2)) * 100
    g = p @ np.array([[2.0, 0.5], [0.3, -1.5]]) + [500, 900] + rng.normal(size=(12, 2))
    df = spark.createDataFrame([(1, *map(float, (*a, *b))) for a, b in zip(p, g, strict=True)] + [(2, 0.0, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0, 0.0), (3, 1.0, 1.0, 1.0, 1.0), (3, 2.0, 2.0, 2.0, 2.0)], "page_id long, pixel_x double, pixel_y double, geo_x double, geo_y double")
    r = {x["page_id"]: x for x in aggs.fit_affine(df).collect()}
    w, *_ = np.linalg.lstsq(np.c_[p, np.ones(12)], g, rcond=None)
    assert np.allclose([r[1][k] for k in "abcdef"], w.T.ravel())
    assert r[1]["rmse"] == pytest.approx(math.sqrt((((np.c_[p, np.ones(12)] @ w - g) ** 2).sum(1)).mean()), abs=1e-4)
    assert r[2]["reason_code"] == "too_few_points" and r[3]["reason_code"] == "degenerate_points"


def test_ece_edges(spark):
    df = spark.createDataFrame([(1.0, True), (1.5, True), (-1.0, False)], "prediction double, is_correct boolean")
    assert aggs.ece(df, [], "prediction", "is_correct").first()["ece"] == 0.0
    assert aggs.ece(df.limit(0), [], "prediction", "is_correct").first()["ece"] == 0.0
    with pytest.raises(ValueError, match="positive"):
        aggs.ece(df, [], "prediction", "is_correct", 0)


def test_decisions_and_dead_letters(spark):
    df = spark.createDataFrame([("a", "review", 1), ("b", "review", 1), ("c", "bogus", 1), ("d", "conflict", 1)], "id string, outcome string, ord int")
    had = spark.createDataFrame([("b", "review"), ("d", "review")], "id string, outcome string")
    assert {r["id"]: r["status"] for r in workflow.decide(df, had).collect()} == {"a": "decided", "b": "replayed", "c": "error", "d": "refused"}
    m = spark.createDataFrame([(4, "q", 4, True), (5, "q", 5, True), (6, "q", 5, False), (7, "q", 6, False)], "id long, queue string, attempts int, failed boolean")
    assert {r["id"]: r["outcome"] for r in workflow.dead_letters(m).collect()} == {4: "retry", 5: "dead_letter", 6: "done", 7: "dead_letter"}


def test_lanes_of_a_page(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    rows = [(1, 1, ring, "EPSG:32643"), (2, 2, ring[:4], "EPSG:32643"), (3, 3, ring, "EPSG:32643"), (4, 4, ring, "EPSG:32643")]
    p = spark.createDataFrame(rows, "page_id long, polygon_id long, ring array<struct<x:double,y:double>>, crs string")
    labels = spark.createDataFrame([(1, 7, "S7", 5.0, 5.0), (3, 8, "S8", 5.0, 5.0), (3, 9, "S9", 6.0, 6.0), (4, 5, "S5", 5.0, 5.0)], "page_id long, label_id long, text string, x double, y double")
    fit = (2.0, 0.0, 100.0, 0.0, 3.0, 200.0)
    fits = spark.createDataFrame([(1, *fit, 1.5), (2, *fit, 9.0), (3, *fit, 1.6), (4, *([None] * 6), None)], "page_id long, a double, b double, c double, d double, e double, f double, rmse double")
    got = {r["polygon_id"]: (r["invalid"], r["label_status"], r["area"], r["eligible"]) for r in workflow.map_lane(p, labels, fits).collect()}
    assert got == {1: (None, "bound", "600.00", True), 2: ("not_closed", "unbound", "0.00", False), 3: (None, "ambiguous", "600.00", False), 4: ("not_georeferenced", "unbound", "0.00", False)}


def test_extractor_plug_in(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "page_id long, html string")
    got = [tuple(r) for r in plugins.extract_with(df, lambda t: [(w, 0.5) for w in t.split()], "html", "page_id").collect()]
    assert got == [(1, 0, "a", 0.5), (1, 1, "b", 0.5)]
