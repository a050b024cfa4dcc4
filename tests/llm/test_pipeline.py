"""Each stage of the corpus pipeline on its own input, against brute force."""

from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as C
from verdigris.llm import bpe, common, quality, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, "one two " * 20, "en", "a", 5), (3, "one two " * 20, "en", "a", 5), (None, " ".join(f"w{i}" for i in range(60)), "fr", "b", 1), (5, " ".join(f"w{i}" for i in range(60)) + " \U0001f600", "fr", "b", 1), (6, " ".join(f"v{i}" for i in range(50)) + " a.b@c.de", "xx", "a", 2)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string")


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_quality_stage(spark, sf, documents):
    kept = {r["doc_id"] for r in C.quality_rules(spark, documents, sf).select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality(documents, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert kept == {d for d, k in verdict.items() if k}
    failed = {r["doc_id"] for r in quality.figures(documents).filter("base_failed").select("doc_id").collect()}
    assert sum(d in kept for d in good if d not in failed) >= 0.85 * sum(d not in failed for d in good)


def test_near_dedup_stage(spark, sf, documents):
    rows = {r["doc_id"]: shingles(r["text"]) for r in documents.collect()}
    group = {r["doc_id"]: r["component_id"] for r in simhash.similar(documents).collect()}
    inverted, pairs = defaultdict(list), Counter()
    for d, s in rows.items():
        for x in s:
            inverted[x].append(d)
    for ds in inverted.values():
        pairs.update((a, b) for i, a in enumerate(ds) for b in ds[i + 1 :])
    score = {p: n / (len(rows[p[0]]) + len(rows[p[1]]) - n) for p, n in pairs.items()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        near = [p for p, j in score.items() if low <= j < high]
        assert sum(group[a] == group[b] for a, b in near) >= 0.99 * len(near)
    partner = defaultdict(float)
    for (a, b), j in score.items():
        partner[a], partner[b] = max(partner[a], j), max(partner[b], j)
    sizes = Counter(group.values())
    assert not [d for d, c in group.items() if sizes[c] > 1 and partner[d] < 0.8]
    kept = [r["doc_id"] for r in C.near_dedup(spark, documents, sf).collect()]
    assert sorted(kept) == sorted({c for c in group.values()})


def test_near_dedup_of_extended_texts(spark):
    """Texts extended by new words, at and around the similarity, give the classes of exact comparison."""
    rows = []
    for g in range(60):
        n = 100 + 15 * g
        words = [f"g{g}w{i}" for i in range(n)]
        rows.append(words)
        for k, share in enumerate((0.09, 0.15, 0.24, 0.26)):
            rows.append(words + [f"g{g}n{k}x{i}" for i in range(int(share * n))])
    own = [set(zip(*(w[i:] for i in range(5)), strict=False)) for w in rows]
    find = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a // 5 * 5, a):
            if 10 * len(own[a] & own[b]) >= 8 * len(own[a] | own[b]):
                x, y = sorted((find[a], find[b]))
                find = [x if f == y else f for f in find]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(df).collect()}
    assert got == dict(enumerate(find))


def test_personal_data_and_mix_stages(spark, sf, documents):
    out = C.personal_data(spark, documents, sf)
    assert out.columns == documents.columns and out.count() == documents.count()
    assert out.filter("text RLIKE '@mail[0-9]'").count() == 0
    assert documents.filter("text RLIKE '@mail[0-9]'").count() > 0
    mixed = C.source_mix(spark, documents, sf)
    assert mixed.columns == documents.columns
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3


def test_token_stage(spark, sf, documents):
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(C.VOCABULARY), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in C.token_ids(spark, documents, sf).collect():
        assert list(bpe.unpacked(bytes(r["token_ids"]))) == encoding.encode_ordinary(texts[r["doc_id"]])


def test_stages_take_odd_rows_and_empty_tables(spark, sf, odd):
    for rows in (odd, odd.limit(0)):
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, rows, sf)
            assert out.columns == rows.columns, name
            out.collect()
        assert C.token_ids(spark, rows, sf).count() == rows.count()
    assert {r["doc_id"] for r in C.near_dedup(spark, odd, sf).collect()} == {1, 3, 5, 6}


def test_run(spark, sf):
    out = C.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "token_ids", "n_tokens"] and out.count() > 50


def test_near_dedup_of_large_groups_in_small_buckets(spark):
    """Groups of near copies and texts that share half their words: blocks of 16, one block and exact comparison give the same classes."""
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(400)]
        for k in range(60):
            words = list(base)
            words[(7 * k) % 400] = f"x{k}"
            rows.append(words)
        rows += [base[:200] + [f"g{g}k{k}w{i}" for i in range(200)] for k in range(40)]
    own = [set(zip(*(w[i:] for i in range(5)), strict=False)) for w in rows]
    find = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 10 * len(own[a] & own[b]) >= 8 * len(own[a] | own[b]):
                x, y = sorted((find[a], find[b]))
                find = [x if f == y else f for f in find]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    for bucket in (16, simhash.BUCKET):
        assert {r["doc_id"]: r["component_id"] for r in simhash.similar(df, bucket=bucket).collect()} == dict(enumerate(find))


def test_near_dedup_searches_fingerprints(spark, monkeypatch):
    """Where no min-hashes meet, near copies are found by their fingerprints, and what these find is still compared."""
    words = [[f"g{g}w{i}" for i in range(400)] for g in range(6)]
    rows = [" ".join(w) for w in words] + [" ".join([*w, "more"]) for w in words] + ["alone", "apart", "", None]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    real = simhash.shared
    monkeypatch.setattr(simhash, "shared", lambda nodes: real(nodes).filter("false"))
    monkeypatch.setattr(simhash, "fingerprint", lambda t, shingle, seed=42, f=simhash.fingerprint: 0 if t in ("alone", "apart") else f(t, shingle, seed))
    fps = [simhash.fingerprint(t, 5) for t in rows]
    near = {g + 6: g for g in range(6) if (fps[g] ^ fps[g + 6]).bit_count() <= 4}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(df).collect()}
    assert len(near) >= 5 and got == {d: near.get(d, d) for d in range(15)} | {15: 14}


def test_narrow_checkpoints_are_few_files(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(1000).repartition(200)
    assert common.cut(df, narrow=True).rdd.getNumPartitions() <= 2 * cores and common.cut(df).count() == 1000
