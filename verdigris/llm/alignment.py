"""How the tokens of two vocabularies lie on the same bytes.

Both encode a document's text; byte offsets at which tokens of both end cut the
tokens into groups, and two tokens are linked where their byte ranges overlap. How
often an id pair is linked in the whole corpus says which tokens stand for each other.

Most groups are one token of each side with the same bytes. `identity` gives for each
A id the B id of the same bytes, so such a group is known by its A id alone: each task
counts them in one vector of the vocabulary's length, and only links of the other,
irregular groups meet as pairs in a shuffle, summed in each task before. Counts of all
pairs then go back to the documents: as sorted arrays to each worker if there are at
most `HELD` pairs, else by a join.

A null or empty text, and one whose tokens' bytes are not space + text on both sides, has
no tokens: zeros and an empty digest. Rows that repeat count as often as they occur; a
null doc_id is a row like any other. A text of any length is aligned whole, in time near
its length; a task holds some runs of texts of RUN characters or its longest text. An
empty table gives an empty result. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import written
from verdigris.llm.records import kept, runs

RUN = 1 << 20
#: Pairs that are sent to the workers as arrays, 17 bytes each; beyond that documents meet them in a join.
HELD = 1 << 21
COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: `same`: A ids of one-to-one identity groups, `pairs`: a * |B| + b of all other links, each with how often.
ALIGNED = f"doc_id long, {COUNTS}, same array<int>, same_n array<int>, pairs array<long>, pairs_n array<int>"
PAIRS = "pair long, n long"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


@dataclass
class Vocabularies:
    """Both tokenizers with the bytes of their ids; made once per Python worker."""

    spec: str
    model: bytes
    pattern: str

    def __post_init__(self):
        import sentencepiece
        import tiktoken

        model, letters = json.loads(self.spec)["model"], byte_letters()
        ids = model["vocab"]
        raw = {i: bytes(letters[c] for c in t) for t, i in ids.items() if all(c in letters for c in t)}
        # Where ids follow the merges, as they do here, merging by id is merging by rank.
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [ids[a + b] for a, b in merges]
        singles = {raw[i] for i in raw if len(raw[i]) == 1}
        if order != sorted(order) or len(singles) != 256:
            raise ValueError("vocabulary A is not a byte-level one whose ids follow its merges")
        ranks = {raw[i]: i for i in [*order, *(ids[t] for t in letters)]}
        self.a = tiktoken.Encoding("a", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [raw.get(i, b"") for i in range(max(ids.values()) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        piece = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in piece]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.identity = identity(self.a_bytes, self.b_bytes, [byte for _, byte in piece])
        marks = [[f"{i}{mark}" for i in range(len(x))] for x, mark in ((self.a_bytes, ","), (self.a_bytes, "|"), (self.b_bytes, ","), (self.b_bytes, ";"))]
        self.marked = pa.array([m for part in marks for m in part], pa.large_string())


def identity(a: list[bytes], b: list[bytes], spelled: list[bool]) -> np.ndarray:
    """For each A id the B id of the same bytes, -1 if none; of several the one that is no spelled-out byte, then the smallest."""
    found: dict[bytes, tuple[bool, int]] = {}
    for i, x in enumerate(b):
        if x and found.get(x, (True, len(b))) > (spelled[i], i):
            found[x] = (spelled[i], i)
    return np.array([found[x][1] if x in found else -1 for x in a], np.int64)


def joined_bytes(table: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The entries of ids one after the other, and where each of them ends (0 first)."""
    got = table.take(pa.array(ids))
    return memoryview(got.buffers()[2] or b""), np.frombuffer(got.buffers()[1], np.int64)[: len(ids) + 1]


def counted(keys: np.ndarray, docs: np.ndarray, n_docs: int, width: int) -> tuple[list, list]:
    """Lists by document of distinct keys below `width`, and of how often each occurs."""
    found, n = np.unique(docs * width + keys, return_counts=True)
    edges = np.searchsorted(found, np.arange(n_docs + 1) * width)
    cut = lambda x: [x[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return cut(found % width), cut(n)


def align(v: Vocabularies, texts: list[str]) -> dict[str, list]:
    """The columns of ALIGNED but doc_id, for texts that are worked on together."""
    whole = [(" " + t).encode() if t else b"" for t in texts]
    a_ids, b_ids = [v.a.encode_ordinary(" " + t) if t else [] for t in texts], v.b.encode(texts, num_threads=1)
    for i, w in enumerate(whole):
        if not w or b"".join(map(v.a_bytes.__getitem__, a_ids[i])) != w or b"".join(map(v.b_bytes.__getitem__, b_ids[i])) != w:
            whole[i], a_ids[i], b_ids[i] = b"", [], []
    n = len(texts)
    size = np.array(list(map(len, whole)), np.int64)
    n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (a_ids, b_ids))
    a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (a_ids, b_ids))
    # Offsets over all texts of the run, one after the other; `at_*` marks where tokens end.
    at_a, at_b = np.zeros(size.sum() + 1, bool), np.zeros(size.sum() + 1, bool)
    at_a[np.cumsum(v.a_len[a])] = True
    at_b[np.cumsum(v.b_len[b])] = True
    at_a[0] = at_b[0] = False
    both, cuts = np.flatnonzero(at_a & at_b), np.flatnonzero(at_a | at_b)
    doc_of = lambda ends: np.searchsorted(np.cumsum(size), ends)
    # Token ends before a cut say which token covers the stretch that ends there: one link each.
    before_a, before_b = np.cumsum(at_a) - at_a, np.cumsum(at_b) - at_b
    link_a, link_b, link_doc = before_a[cuts], before_b[cuts], doc_of(cuts)
    # Groups: how many tokens of each side, and which group each token and link is in.
    last_a, last_b = before_a[both], before_b[both]
    group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
    link_group = np.searchsorted(both, cuts)
    in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    same = (in_a == 1) & (in_b == 1) & (v.identity[a[last_a]] == b[last_b])
    irregular = ~same[link_group] if len(both) else np.zeros(0, bool)
    doc_group = doc_of(both)
    same_ids, same_n = counted(a[last_a[same]], doc_group[same], n, len(v.a_bytes))
    pairs, pairs_n = counted(a[link_a[irregular]] * len(v.b_bytes) + b[link_b[irregular]], link_doc[irregular], n, len(v.a_bytes) * len(v.b_bytes))
    # a1,a2|b1;a3|b2,b3: a token's place is its own rank plus the other side's tokens of groups before (or of its own, for B).
    end_a, end_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    end_a[last_a], end_b[last_b] = True, True
    listed = np.empty(len(a) + len(b), np.int64)
    done_b, done_a = np.concatenate([[0], last_b + 1]), last_a + 1
    listed[np.arange(len(a)) + done_b[group_a]] = a + np.where(end_a, len(v.a_bytes), 0)
    listed[np.arange(len(b)) + done_a[group_b]] = b + 2 * len(v.a_bytes) + np.where(end_b, len(v.b_bytes), 0)
    text, ends = joined_bytes(v.marked, listed)
    edges = ends[np.cumsum([0, *(n_a + n_b)])].tolist()
    digests = [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(edges[:-1], edges[1:], strict=True)]
    per_doc = lambda d: np.bincount(d, minlength=n)
    return {"n_a": n_a, "n_b": n_b, "n_groups": per_doc(doc_group), "n_links": per_doc(link_doc), "groups_sha256": digests, "same": same_ids, "same_n": same_n, "pairs": pairs, "pairs_n": pairs_n}


def lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), kind))


class Both:
    """The files of both vocabularies, broadcast (their size is that of the vocabularies)."""

    def __init__(self, spark: SparkSession, a: str, b: str, pattern: str):
        with open(a, encoding="utf-8") as f, open(b, "rb") as g:
            parts = (f.read(), base64.b64encode(g.read()), pattern)
        self.cast, self.key = spark.sparkContext.broadcast(parts), f"{a}\n{b}\n{pattern}"

    def get(self) -> Vocabularies:
        def make():
            spec, model, pattern = self.cast.value
            return Vocabularies(spec, base64.b64decode(model), pattern)

        return kept("vocabularies", self.key, make)


def aligned(docs: DataFrame, both: Both) -> DataFrame:
    """Each document's counts, digest and distinct links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = both.get()
        for batch in batches:
            ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in runs([len(t) + 1 for t in texts], RUN):
                got = align(v, texts[a:b])
                kinds = {"same": pa.int32(), "same_n": pa.int32(), "pairs": pa.int64(), "pairs_n": pa.int32()}
                cols = {k: lists(x, kinds[k]) if k in kinds else pa.array(x, pa.string()) if k == "groups_sha256" else pa.array(x, pa.int64()) for k, x in got.items()}
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(a, b - a)} | cols)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def pair_counts(found: DataFrame, both: Both) -> DataFrame:
    """How many links of the corpus hold each id pair, and whether it is the most of its B id's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = both.get()
        vector = np.zeros(len(v.a_bytes), np.int64)
        for batch in batches:
            same, n = (batch.column(c).flatten().to_numpy() for c in ("same", "same_n"))
            np.add.at(vector, same, n)
            pairs, n = (batch.column(c).flatten().to_numpy() for c in ("pairs", "pairs_n"))
            keys, at = np.unique(pairs, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"pair": keys.astype(np.int64), "n": np.bincount(at, n, len(keys)).astype(np.int64)})
        a = np.flatnonzero(vector)
        yield pa.RecordBatch.from_pydict({"pair": a * len(v.b_bytes) + v.identity[a], "n": vector[a]})

    width = len(both.get().b_bytes)
    counts = found.select("same", "same_n", "pairs", "pairs_n").mapInArrow(run, PAIRS).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts, "token-pairs")
    # B ids are a vocabulary's; the largest count of each is one row.
    most = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("most"))
    joined = counts.withColumn("b", F.col("pair") % width).join(most, "b")
    return written(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "token-pairs-best")


def alignment(docs: DataFrame, a: str, b: str, pattern: str, held: int = HELD) -> DataFrame:
    """COUNTS by document with n_best and count_sum, from vocabulary files `a` and `b`.

    `pattern` splits text before A's merges, as its file's own pre-tokenizer does.
    """
    spark = docs.sparkSession
    both = Both(spark, a, b, pattern)
    found = written(aligned(docs, both), "aligned")
    counts = pair_counts(found, both)
    return _with_held(found, counts, both) if counts.count() <= held else _with_joined(found, counts, both)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def _with_held(found: DataFrame, counts: DataFrame, both: Both) -> DataFrame:
    """Counts of few pairs as arrays on each worker; documents stay where they are."""
    rows = counts.orderBy("pair").toPandas()
    cast = found.sparkSession.sparkContext.broadcast((rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["best"].to_numpy(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = both.get()
        pair, n, best = cast.value
        for batch in batches:
            n_best, count_sum = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for c in ("same", "pairs"):
                col, times = batch.column(c), batch.column(f"{c}_n").flatten().to_numpy().astype(np.int64)
                keys = col.flatten().to_numpy().astype(np.int64)
                keys = keys * len(v.b_bytes) + v.identity[keys] if c == "same" else keys
                at, doc = np.searchsorted(pair, keys), np.repeat(np.arange(len(batch)), np.diff(col.offsets.to_numpy()))
                np.add.at(n_best, doc, times * best[at])
                np.add.at(count_sum, doc, times * n[at])
            kept_cols = {c: batch.column(c) for c in RESULT.replace(" long", "").replace(" string", "").split(", ")[:6]}
            yield pa.RecordBatch.from_pydict(kept_cols | {"n_best": n_best, "count_sum": count_sum})

    return found.mapInArrow(run, RESULT)


def _with_joined(found: DataFrame, counts: DataFrame, both: Both) -> DataFrame:
    """Counts of many pairs by a join; documents' links are keyed by a row number, a frequent pair is split by AQE."""
    v = both.get()
    spark = found.sparkSession
    ids = spark.createDataFrame([(i, int(b)) for i, b in enumerate(v.identity) if b >= 0], "a int, b long")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "aligned-rows")
    zipped = lambda c: F.explode(F.arrays_zip(c, f"{c}_n")).alias("x")
    same = found.select("row", zipped("same")).select("row", F.col("x.same").alias("a"), F.col("x.same_n").alias("times")).join(F.broadcast(ids), "a")
    links = same.select("row", (F.col("a").cast("long") * len(v.b_bytes) + F.col("b")).alias("pair"), "times").unionByName(found.select("row", zipped("pairs")).select("row", F.col("x.pairs").alias("pair"), F.col("x.pairs_n").alias("times")))
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0).cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = found.join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return out.select(*[c.split()[0] for c in RESULT.split(", ")])
