"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits, each set if it is set in over half of the XXH64 values of
a text's shingles. Two fingerprints link if at most `distance` bits differ.

Search. The 64 bits are split into parts, correlated bits into the same part
(greedy, from the correlations over all fingerprints). If the parts' thresholds
add up to distance - parts + 1, then any linked pair is within its threshold on
at least one part. The thresholds are allotted by dynamic programming on
estimated candidate counts: the part's collisions over all fingerprints, widened
by the odds of single bits. A part of threshold t is indexed by its value and
probed with all values within t; a threshold of -1 leaves the part out. The
number of parts with the smallest estimate is taken.

Equal fingerprints are first made one row. Buckets (part, value) of more than
`BUCKET` fingerprints are split again by the pigeonhole principle on the other
bits, and what is still larger is dealt as pairs of blocks, so a task never holds
more than two blocks of a bucket, and no link is lost. Within a bucket all
distances are checked and only a spanning forest leaves it, so a group of n
near copies gives about n rows, not n squared.

Components are found by large and small stars in turn, in rounds about the
logarithm of the longest path; each round is checkpointed in the shared folder.

Nulls: a null text has no shingles and fingerprint zero, like an empty one; it is
linked like any other. Documents with a null doc_id get a fingerprint and the
component of their fingerprint. Repeated rows are kept. Extra columns are not
read. An empty table gives an empty one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import cut, nothing_in, written

BUCKET = 8192
BITS, SIG = 64, 256
#: Odds of losing a pair that has just the similarity asked for: by not meeting, and by its min-hashes.
UNMET, MISS = 1e-3, 1e-2
#: A label that a third of all rows may carry meets its table in so many tasks; texts compared with one other at a time.
SALTS, COMPARED = 32, 256
#: Partners that a node is compared with before what follows from those is left out.
FIRST = 3
FACTORS = np.random.default_rng(9).integers(0, 1 << 63, SIG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """The fingerprint of a text; A-Z are lower-cased, words are split at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends.tolist()
    n = max(1, len(words) - shingle + 1)
    last = [ends[-1]] if len(words) < shingle else ends[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    out = np.zeros(BITS, np.int64)
    for k in range(0, n, 65_536):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[k : min(n, k + 65_536)], last[k : k + 65_536], strict=True)], dtype="<u8")
        out += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(out * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long)."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each two bits are set together (64 x 64), over all of them."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = _bits(b.column("fp").to_numpy(zero_copy_only=False)).astype(np.float64)
            n, both = n + len(x), both + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1)), pa.array([float(n), *both.ravel()])], names=["k", "v"])

    rows = fps.select("fp").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(BITS * BITS + 1)
    for r in rows:
        v[r["k"]] = r["v"]
    return int(v[0]), v[1:].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits to parts of near equal width; a part takes the bits most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        if k == parts - 1:
            out.append(sorted(free))
            break
        pool = sorted(free)
        pair = max(itertools.combinations(pool, 2), key=lambda x: corr[x[0], x[1]])
        part = list(pair)[:width]
        while len(part) < width:
            part.append(max((b for b in pool if b not in part), key=lambda b: corr[b, part].mean()))
        free -= set(part)
        out.append(sorted(part))
    return out


def allotted(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 and up, adding up to `total`) of least cost by dynamic programming; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t, more in enumerate(cost):
                key = used + t
                if key not in new or c + more < new[key][0]:
                    new[key] = (c + more, [*chosen, t - 1])
        best = new
    return best.get(total + len(costs), (float("inf"), []))


def part_value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def plan(fps: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """The parts (bits, threshold) that are searched; statistics cover all fingerprints."""
    n, both = moments(fps)
    p = np.diag(both) / max(n, 1)
    odds = np.maximum(2 * p * (1 - p), 1e-3)
    odds = odds / (1 - np.minimum(odds, 0.999))
    layouts = [grouped_bits(n, both, m) for m in range(max(2, distance // 2), distance + 2)]
    cols = []
    for i, parts in enumerate(layouts):
        for k, bits in enumerate(parts):
            cols.append((i, k, bits))

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for c, (_, _, bits) in enumerate(cols):
                v, m = np.unique(part_value(fp, bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c)), pa.array(v.view(np.int64)), pa.array(m)], names=["c", "v", "m"])

    met = fps.select("fp").mapInArrow(run, "c long, v long, m long").groupBy("c", "v").agg(F.sum("m").alias("m"))
    same = {r["c"]: float(r["s"]) for r in met.groupBy("c").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("s")).collect()}
    best = (float("inf"), [], [])
    for i, parts in enumerate(layouts):
        costs = []
        for c, (j, _, bits) in enumerate(cols):
            if j != i:
                continue
            cost, poly, rows = [0.0], [1.0], 1.0
            for t in range(min(3, distance) + 1):
                if t:  # pairs that differ in just t bits of the part, from the bits' odds
                    poly.append(sum(float(np.prod([odds[b] for b in x])) for x in itertools.combinations(bits, t)) if t < 3 else poly[-1] * poly[1])
                    rows += float(len(list(itertools.combinations(bits, t)))) if t < 3 else rows * len(bits)
                cost.append(same.get(c, 0.0) * sum(poly) + 500.0 * n * rows)  # a row dealt costs about as much as 500 distances
            costs.append(cost)
        cost, chosen = allotted(costs, distance - len(parts) + 1)
        if cost < best[0]:
            best = (cost, parts, chosen)
    return [(b, t) for b, t in zip(best[1], best[2], strict=True) if t >= 0]


def probes(width: int, t: int) -> np.ndarray:
    """All patterns of up to t bits in `width`."""
    return np.array([sum(1 << b for b in x) for k in range(t + 1) for x in itertools.combinations(range(width), k)], np.uint64)


def keyed(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Rows (part, value, and the columns of `nodes`): each in the bucket of its value and of all values within the threshold."""
    shapes, names = [probes(len(bits), t) for bits, t in parts], ["part", "value", *nodes.columns]

    def run(batches):
        for batch in batches:
            whole = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (bits, _) in enumerate(parts):
                step = max(1, 100_000 // len(shapes[k]))
                for a in range(0, len(whole), step):
                    fp = whole[a : a + step]
                    v = (part_value(fp, bits)[:, None] ^ shapes[k][None, :]).ravel()
                    rows = batch.take(pa.array(np.repeat(np.arange(a, a + len(fp)), len(shapes[k]))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(v.view(np.int64)), *rows.columns], names=names)

    return nodes.mapInArrow(run, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("value", T.LongType()), *nodes.schema.fields]))


def _refined(rows: DataFrame, parts: list[tuple[list[int], int]], distance: int) -> DataFrame:
    """Members of large buckets again by distance + 1 slices of the bits outside the bucket's part."""
    slices, names = [], [*rows.columns, "sub"]
    for bits, _ in parts:
        rest = [b for b in range(BITS) if b not in bits]
        slices.append([rest[i :: distance + 1] for i in range(distance + 1)])

    def run(batches):
        for b in batches:
            part = b.column("part").to_numpy(zero_copy_only=False)
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                some = b.take(pa.array(at))
                for k, bits in enumerate(slices[p]):
                    sub = part_value(fp[at], bits) | np.uint64(k << 60)
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(sub.view(np.int64))], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("sub", T.LongType())]))


def forest(n: int, close: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Edges (places, m x 2) that connect all members of a bucket that are close.

    `close(a, b)` gives a matrix for two arrays of places. Few close pairs are
    thinned to a forest. Dense groups are searched breadth first over those not
    yet reached, which uses them up in few steps and gives a tree.
    """
    every, hits, found = np.arange(n), 0, []
    for k in range(0, n - 1, 512):
        x, y = np.nonzero(np.triu(close(every[k : k + 512], every[k:]), 1))
        hits += len(x)
        if hits > 4 * n:
            break
        found.append(np.stack([k + x, k + y], 1))
    else:
        return spanning(np.concatenate(found)) if found else np.empty((0, 2), np.int64)
    out, left = [], every
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = close(np.array([x]), left)[0]
            if near.any():
                out.append(np.stack([np.full(int(near.sum()), x), left[near]], 1))
                queue += list(left[near])
                left = left[~near]
    return np.concatenate(out)


def spanning(pairs: np.ndarray) -> np.ndarray:
    """The pairs that join what those before them did not; in the order of places, so that buckets tend to agree."""
    root: dict[int, int] = {}
    kept = []
    for k, (x, y) in enumerate(pairs.tolist()):
        while (r := root.get(x, x)) != x:
            root[x] = x = root.get(r, r)
        while (r := root.get(y, y)) != y:
            root[y] = y = root.get(r, r)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return pairs[kept]


def closeness(fp: np.ndarray, distance: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """At most `distance` bits apart."""
    return lambda a, b: np.bitwise_count(fp[a][:, None] ^ fp[b][None, :]) <= distance


def links(nodes: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between nodes (fp, distinct) such that all linked ones are connected."""
    names = ["fp"]
    parts = plan(nodes, distance)
    rows = keyed(nodes, parts)
    large = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket)
    marked = rows.join(large, ["part", "value"], "left")
    small = marked.filter("n IS NULL").select("part", "value", F.lit(0).cast("long").alias("sub"), F.lit(0).alias("a"), F.lit(0).alias("b"), *names)
    big = marked.filter("n IS NOT NULL").select("part", "value", *names)
    finer = _refined(big, parts, distance)
    each = finer.groupBy("part", "value", "sub").agg(F.count(F.lit(1)).alias("n"))
    # Slices pay where they leave fewer pairs than the bucket has; a dense group is dealt as it is.
    gain = cut(each.groupBy("part", "value").agg(F.sum(F.col("n") * F.col("n")).alias("_s")).join(large, ["part", "value"]).select("part", "value", "n", (F.col("_s") < F.col("n") * F.col("n")).alias("_slice")))
    finer = finer.join(each.filter("n > 1"), ["part", "value", "sub"]).join(gain.filter("_slice").select("part", "value"), ["part", "value"])
    whole = big.join(gain.filter("NOT _slice").select("part", "value", "n"), ["part", "value"]).withColumn("sub", F.lit(-1).cast("long"))
    fine = finer.select("part", "value", "sub", "n", *names).unionByName(whole.select("part", "value", "sub", "n", *names))
    # Blocks of what is still large: every pair of blocks meets once.
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    mine = F.pmod(F.xxhash64(*names), blocks).cast("int")
    fine = fine.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("m", mine)
    fine = fine.select("part", "value", "sub", F.least("o", "m").alias("a"), F.greatest("o", "m").alias("b"), *names)
    buckets = small.unionByName(fine).groupBy("part", "value", "sub", "a", "b").agg(F.collect_list("fp").alias("fp")).filter(F.size("fp") > 1).select("fp")

    def run(batches):
        for batch in batches:
            out = [np.empty((0, 2), np.int64)]
            for k in range(batch.num_rows):
                ids = np.unique(batch.column("fp")[k].values.to_numpy(zero_copy_only=False))
                e = forest(len(ids), closeness(ids.view(np.uint64), distance))
                if len(e):
                    out.append(ids[e])
            e = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    return buckets.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for all nodes of `edges` (a, b).

    Large stars (larger neighbours go to the smallest one) and small stars (the
    smaller ones do) in turn until every node but the roots has one edge, to a root.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), narrow=True)
    while True:
        node = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        if nothing_in(node.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1")):
            break
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = cut(small.distinct(), narrow=True)
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select("b", "b").distinct())


def least_of(classes: DataFrame, value: str, out: str) -> DataFrame:
    """`classes` (node, label, value): node and the least value of its label; labels are salted, since one may have a third of all nodes."""
    least = classes.groupBy("label").agg(F.min(value).alias(out)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return classes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(least, ["label", "salt"]).select("node", out)


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included)."""
    rows = cut(fingerprints(docs, shingle))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = links(nodes.select("fp"), distance, bucket)
    label = components(found)  # in fingerprints; the smallest doc_id of each class follows
    linked = least_of(label.join(nodes.select(F.col("fp").alias("node"), "first"), "node"), "first", "least")
    named = nodes.join(linked.withColumnRenamed("node", "fp").withColumn("linked", F.lit(True)), "fp", "left").select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """The distinct XXH64 values of a text's shingles, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    ends = ends.tolist()
    last = [ends[-1]] if len(words) < shingle else ends[shingle - 1 :]
    return np.unique(np.array([digest(line[a:b], 42) for a, b in zip(starts, last, strict=False)], np.uint64))


def signature(h: np.ndarray) -> tuple[np.ndarray, bytes]:
    """SIG min-hashes of a set of hashes, and eight bits of each.

    Two sets of the Jaccard similarity J agree in about SIG * J of the former, and
    in hardly any more of the latter.
    """
    if not len(h):
        return np.zeros(SIG, np.uint64), bytes(SIG)
    least = np.full(SIG, np.iinfo(np.uint64).max)
    for k in range(0, len(h), 4096):
        some = h[k : k + 4096]
        for m in range(0, SIG, 32):
            np.minimum(least[m : m + 32], (some[None, :] * FACTORS[m : m + 32, None]).min(1), out=least[m : m + 32])
    return least, (least >> np.uint64(7)).astype(np.uint8).tobytes()


def layout(similarity: float) -> tuple[int, int, int]:
    """Bands, min-hashes a band and fewest equal min-hashes, for the odds of losing a pair of the similarity that UNMET and MISS allow."""
    width = max((r for r in range(1, SIG + 1) if (1 - similarity**r) ** (SIG // r) <= UNMET), default=1)
    bands = next(b for b in range(1, SIG // width + 1) if b == SIG // width or (1 - similarity**width) ** b <= UNMET)
    least, below = 0, 0.0
    while least < SIG:
        below += math.comb(SIG, least) * similarity**least * (1 - similarity) ** (SIG - least)
        if below > MISS:
            break
        least += 1
    return bands, width, least


def alike(sig: np.ndarray, least: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether members (places) have `least` equal min-hashes, of signatures (n x SIG bytes).

    One bit of each min-hash gives a bound for all pairs by one product; only those
    that pass it, five deviations wide, are counted.
    """
    signs = (sig & 1).astype(np.float32) * 2 - 1
    odds = (1 - least / SIG) / 2
    floor = SIG - 2 * (SIG * odds + 5 * math.sqrt(SIG * odds * (1 - odds)))

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        near = signs[a] @ signs[b].T >= floor
        x, y = np.nonzero(near)
        for k in range(0, len(x), 1 << 16):
            i, j = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            near[i, j] = (sig[a[i]] == sig[b[j]]).sum(1) >= least
        return near

    return close


def between(sig: np.ndarray, label: np.ndarray, refuted: np.ndarray, least: int, each: int) -> np.ndarray:
    """Pairs (places, m x 2) of at least `least` equal min-hashes, `each` with the most for any two labels, without the refuted ones."""
    n, close = len(sig), alike(sig, least)
    name = np.unique(label, return_inverse=True)[1].astype(np.int64)
    every, gone, out = np.arange(n), np.unique(refuted[:, 0] * n + refuted[:, 1]), np.empty((0, 3), np.int64)
    for k in range(0, n - 1, 512):
        x, y = np.nonzero(np.triu(close(every[k : k + 512], every[k:]), 1) & (name[k : k + 512][:, None] != name[k:][None, :]))
        x, y = x + k, y + k
        new = ~np.isin(x * n + y, gone)
        x, y = x[new], y[new]
        same = np.concatenate([np.empty(0, np.int64), *[(sig[x[i : i + 65_536]] == sig[y[i : i + 65_536]]).sum(1) for i in range(0, len(x), 65_536)]])
        out = np.concatenate([out, np.stack([x, y, -same], 1)])
        low, high = np.minimum(name[out[:, 0]], name[out[:, 1]]), np.maximum(name[out[:, 0]], name[out[:, 1]])
        order = np.lexsort((out[:, 1], out[:, 0], out[:, 2], high, low))
        out, group = out[order], (low * n + high)[order]
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
        out = out[np.arange(len(out)) - np.repeat(start, np.diff(np.r_[start, len(out)])) < each]
    return out[:, :2]


def shared(nodes: DataFrame) -> DataFrame:
    """value, hub, n, id of all `nodes` (id, band) whose value of a band is that of another; hub: the smallest of the value's n ids."""
    bands = nodes.select("id", F.explode("band").alias("value"))
    values = bands.groupBy("value").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return bands.join(values, "value").select("value", "hub", "n", "id")


def hub_pairs(meeting: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """a, b: ids (`meeting`: see `shared`) and a hub of theirs with at least `least` equal min-hashes (`sigs`: id, sig)."""
    pairs = meeting.filter("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SIG) for c in ("sig_a", "sig_b"))
            yield b.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return both.mapInArrow(run, "a long, b long")


def met(meeting: DataFrame, label: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Buckets (key, id: list of nodes) of nodes of two and more classes; every two nodes of a value and of different classes meet in one.

    `meeting`: see `shared`; `label`: node, label (others are classes of their own).
    Values of more than `bucket` nodes are dealt as pairs of blocks.
    """
    named = meeting.join(label.withColumnRenamed("node", "id"), "id", "left").select("value", "n", "id", F.coalesce("label", "id").alias("label"))
    several = [F.min("label").alias("low"), F.max("label").alias("high")]
    mixed = named.groupBy("value").agg(*several).filter("low < high").select("value")
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    rows = named.join(mixed, "value").withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("m", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    rows = rows.select(F.xxhash64("value", F.least("o", "m"), F.greatest("o", "m")).alias("key"), "id", "label")
    return rows.groupBy("key").agg(F.collect_list("id").alias("id"), *several).filter("low < high").select("key", "id")


def signed(buckets: DataFrame, sigs: DataFrame) -> DataFrame:
    """The `buckets` (key, id: list) with the list of their nodes' signatures (`sigs`: id, sig)."""
    rows = buckets.select("key", F.explode("id").alias("id")).join(sigs, "id")
    tasks = int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "key").groupBy("key").agg(F.collect_list("id").alias("id"), F.collect_list("sig").alias("sig"))


def likely(buckets: DataFrame, least: int) -> DataFrame:
    """a, b (a < b): in each bucket (id, sig) a spanning forest of the pairs of at least `least` equal min-hashes.

    Trees start at the smallest ids, so that the buckets of a group give much the same edges.
    """

    def run(batches):
        for batch in batches:
            out = [np.empty((0, 2), np.int64)]
            for k in range(batch.num_rows):
                ids, at, sig = _members(batch, k)
                out.append(ids[forest(len(ids), alike(sig, least))])
            e = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(e.min(1)), pa.array(e.max(1))], names=["a", "b"])

    return buckets.select("id", "sig").mapInArrow(run, "a long, b long").distinct()


def _members(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, their places in the bucket's lists, and signatures of bucket number k."""
    ids, at = np.unique(batch.column("id")[k].values.to_numpy(zero_copy_only=False), return_index=True)
    return ids, at, np.frombuffer(b"".join(batch.column("sig")[k].values.to_pylist()), np.uint8).reshape(-1, SIG)[at]


def more_likely(buckets: DataFrame, least: int, each: int) -> DataFrame:
    """a, b: `each` pairs to compare next for any two labels of a bucket (id, sig, label, refuted: pairs) that likely pairs join."""

    def run(batches):
        for batch in batches:
            out = [np.empty((0, 2), np.int64)]
            for k in range(batch.num_rows):
                ids, at, sig = _members(batch, k)
                label = batch.column("label")[k].values.to_numpy(zero_copy_only=False)[at]
                pairs = np.array([(x["a"], x["b"]) for x in batch.column("refuted")[k].as_py()], np.int64).reshape(-1, 2)
                out.append(ids[between(sig, label, np.searchsorted(ids, pairs), least, each)])
            e = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    return buckets.select("id", "sig", "label", "refuted").mapInArrow(run, "a long, b long").distinct()


def compared(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b, ok: whether the shingle sets of two nodes have the Jaccard similarity; `texts`: id, text.

    A text meets those it is compared with in groups of about COMPARED, so it is
    moved once a group, and no group holds more.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / COMPARED).cast("int").alias("parts"))
    texts = texts.hint("shuffle_merge")  # they grow with the documents
    left = many.join(texts.withColumnRenamed("id", "a"), "a").select(F.col("a").alias("a"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("text").alias("text"))
    right = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")).join(texts.withColumnRenamed("id", "b"), "b")

    def meet(one: pa.Table, others: pa.Table) -> pa.Table:
        ok, x = [], hashes(one.column("text")[0].as_py(), shingle) if one.num_rows else None
        for t in others.column("text"):
            y = hashes(t.as_py(), shingle)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
        return pa.table({"a": others.column("a"), "b": others.column("b"), "ok": pa.array(ok, pa.bool_())})

    return left.groupBy("a", "part").cogroup(right.groupBy("a", "part")).applyInArrow(meet, "a long, b long, ok boolean")


def fingerprint_pairs(nodes: DataFrame, distance: int, bucket: int) -> DataFrame:
    """a, b (a < b): ids of `nodes` (id, fp) by the pigeonhole search (`links`) over their fingerprints.

    Nodes of a fingerprint meet its smallest id, and the smallest ids of linked fingerprints each other.
    """
    hubs = cut(nodes.groupBy("fp").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")))
    same = nodes.join(hubs.filter("n > 1").select("fp", "hub"), "fp").filter("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    end = lambda c: hubs.select(F.col("fp").alias(c), F.col("hub").alias(f"hub_{c}"))
    found = cut(links(hubs.select("fp"), distance, bucket), narrow=True)
    across = found.join(end("a"), "a").join(end("b"), "b").select(F.least("hub_a", "hub_b").alias("a"), F.greatest("hub_a", "hub_b").alias("b"))
    return same.union(across)


def classes_of(docs: DataFrame, shingle: int, similarity: float, bucket: int, distance: int = 4) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash of the text, id of its shingle set) and (node, label) of the sets that have partners.

    Texts meet by their fingerprints, at most `distance` bits apart (`fingerprint_pairs`),
    and, since fingerprints of similar sets may be further apart than any search
    reaches, where all min-hashes of a band agree; the bands follow from the
    similarity alone, so the vocabulary does not matter. First each node is held
    against those that its fingerprint finds and the smallest one that it meets in
    each band; buckets whose nodes are of one class by then have nothing more to tell. In each of the others the likely
    pairs are thinned to a spanning forest. Of the pairs each node takes its FIRST
    smallest partners first; of the others those within a class that stands by then
    are left out; what is taken is compared exactly. Buckets that lost an edge are
    searched again for pairs between their classes, more in every round, until every
    likely pair is joined or refuted. Signatures travel only with pairs and with
    buckets of several classes, and are not stored again.
    """
    bands, width, fewest = layout(similarity)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("hash", T.LongType()), T.StructField("id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("band", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps, sigs, values = [], [], [], []
            for t in b.column("text").to_pylist():
                h = hashes(t, shingle)
                fps.append(fingerprint(t, shingle))
                least, sig = signature(h)
                ids.append(xxhash.xxh64_intdigest(h.tobytes()))
                sigs.append(sig)
                values.append([xxhash.xxh64_intdigest(least[k * width : (k + 1) * width].tobytes(), k) for k in range(bands)])
            flat = pa.array(np.array(values, np.uint64).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sigs, pa.binary()), lists], names=schema.names)

    texts = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    rows = cut(texts.mapInArrow(run, schema))
    nodes = rows.groupBy("id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("held"), F.min_by("fp", "hash").alias("fp"), F.min_by("sig", "hash").alias("sig"), F.min_by("band", "hash").alias("band"))
    nodes = cut(nodes.select("id", F.col("held.doc_id").alias("held"), "held.hash", "fp", "sig", "band"))
    groups = cut(shared(nodes))
    close = cut(fingerprint_pairs(nodes.select("id", "fp"), distance, bucket))
    # Of the nodes only those that meet any other are read again.
    found = groups.select("id").union(close.select(F.explode(F.array("a", "b")).alias("id")))
    meeting = cut(found.distinct().join(nodes.select("id", "held", "hash", "sig"), "id"))
    sigs = meeting.select("id", "sig")
    # Their texts are moved once, by one of their rows; a
    # shuffled join at every size, since what meets grows with the documents.
    kept = texts.join(meeting.select("id", "held", F.col("hash").alias("h")).hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("held")) & (F.col("hash") == F.col("h")))
    pool = written(kept.groupBy("id").agg(F.min("text").alias("text")), "texts")

    bad, label = docs.sparkSession.createDataFrame([], "a long, b long"), docs.sparkSession.createDataFrame([], "node long, label long")
    of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))
    named = lambda p: p.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("l_a", "a").alias("label_a"), F.coalesce("l_b", "b").alias("label_b"))
    todo, thin, more, whole, buckets = cut(hub_pairs(groups, sigs, fewest).union(close).distinct(), narrow=True), True, 64, False, None
    while True:
        first = F.row_number().over(W.partitionBy("b").orderBy("a"))
        taken = todo.withColumn("r", first).filter(F.col("r") <= FIRST).select("a", "b") if thin else todo
        tried = cut(compared(taken, pool, shingle, similarity))
        bad = cut(bad.union(tried.filter("NOT ok").select("a", "b")), narrow=True)
        ok = tried.filter("ok").select("a", "b").union(label.select(F.col("label").alias("a"), F.col("node").alias("b")))
        label = components(ok)
        untried = lambda p: named(p).filter("label_a <> label_b").select("a", "b").join(bad, ["a", "b"], "left_anti")  # noqa: B023, E731
        todo, thin = cut(untried(todo), narrow=True), False
        if todo.isEmpty() and buckets is None:
            buckets = cut(met(groups, label, bucket))
            todo, thin = cut(untried(likely(signed(buckets, sigs), fewest)), narrow=True), True
        if todo.isEmpty():
            if whole:
                break
            todo = cut(more_likely(refuted_buckets(buckets, sigs, bad, label), fewest, more))
            if todo.isEmpty():
                break
            # Where no two classes have as many pairs as were asked for, these are all.
            whole = nothing_in(named(todo).groupBy(F.least("label_a", "label_b"), F.greatest("label_a", "label_b")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= more))
            more *= 16
    return rows.select("doc_id", "hash", "id"), label


def refuted_buckets(buckets: DataFrame, sigs: DataFrame, bad: DataFrame, label: DataFrame) -> DataFrame:
    """Buckets (id, sig, label, refuted) that hold a refuted pair of nodes with different labels, and those pairs."""
    members = buckets.select("key", F.explode("id").alias("id"))
    of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))
    apart = bad.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("l_a", "a") != F.coalesce("l_b", "b")).select("a", "b")
    ends = apart.select("a", "b", F.col("a").alias("id")).union(apart.select("a", "b", F.col("b")))
    inside = ends.join(members, "id").groupBy("key", "a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = inside.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("refuted"))
    labelled = members.join(pairs.select("key"), "key").join(label.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    each = labelled.join(sigs, "id").groupBy("key").agg(*[F.collect_list(c).alias(c) for c in ("id", "sig", "label")])
    return each.join(pairs, "key")


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bucket: int = BUCKET) -> DataFrame:
    """doc_id and component_id: texts whose shingle sets have a Jaccard similarity of `similarity` or more are linked."""
    rows, label = classes_of(docs, shingle, similarity, bucket)
    nodes = rows.groupBy("id").agg(F.min("doc_id").alias("first"))
    linked = least_of(label.join(nodes.withColumnRenamed("id", "node"), "node"), "first", "least").withColumn("linked", F.lit(True))
    named = nodes.join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    return rows.join(named, "id").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document (the smallest doc_id, null last) of each group of near copies, with the columns of `docs`; of repeated rows one stays.

    The rows that go are a table of ids and hashes, which grows with the documents, so the texts meet it by a shuffled join at every size.
    """
    rows, label = classes_of(docs, shingle, similarity, BUCKET)
    tagged = rows.join(label.withColumnRenamed("node", "id"), "id", "left").select("doc_id", "hash", F.coalesce("label", "id").alias("label"))
    each = cut(tagged.groupBy("label", "doc_id", "hash").agg(F.count(F.lit(1)).alias("n")))
    mark = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    many = each.groupBy("label").agg(F.min(mark).alias("best"), F.count(F.lit(1)).alias("members")).filter("members > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    losers = each.withColumn("salt", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(SALTS)).cast("int")).join(many, ["label", "salt"]).filter(mark != F.col("best")).select(F.col("doc_id").alias("gone"), F.col("hash").alias("gone_hash"))
    again = each.filter("n > 1").select(F.col("doc_id").alias("gone"), F.col("hash").alias("gone_hash"))
    losers, again = written(losers, "losers"), written(again, "repeated")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"))
    same = F.col("d").eqNullSafe(F.col("gone")) & (F.col("h") == F.col("gone_hash"))
    stays = packed.join(losers.hint("shuffle_merge"), same, "left_anti")
    if not again.isEmpty():
        one = stays.join(again.distinct(), same, "left_semi").groupBy("d", "h").agg(F.min("row").alias("row"))
        stays = stays.join(again, same, "left_anti").unionByName(one)
    return stays.select("row.*")


def hexed(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
