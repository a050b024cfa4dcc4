"""Nearest neighbours by inner product with an adaptive dimension scan.

Index. Equal vectors are one row with their smallest ids (more than k + 1 of them
can never be returned). A vector x is lengthened by sqrt(M^2 - |x|^2), which makes
the largest inner product the smallest distance, and rotated by a random
orthogonal matrix. Lists of about `LIST` vectors come from k-means on a bounded
sample (`SAMPLE` vectors, those with the lowest hashes of vec_id); every vector is
indexed. Beyond `CENTRES` lists a second codebook splits each of them by what is
left of a vector after its centre, so their number grows with the table while the
model stays small. Lists are dealt to segments of about `SEGMENT` rows, so a large
list is many tasks, and a list with many queries meets them in several pieces.

Search. A query goes to its nearest lists in rounds of 1, 3, 12, 48, ... lists.
After each round its k-th best score is known and goes with it: a segment only
returns what is as good, so a round gives each query a few times k rows however
large the table is. A segment keeps its vectors in blocks of columns. The
distances grow block by block, and after each block a candidate goes if its
partial distance, by the law for random projections, is unlikely (`EPS`) to belong
to a distance under the k-th best so far. What remains is scored exactly on the
original vectors in double precision.

Vectors that are null, zero or hold null or non-finite components, and rows with
a null vec_id, take no part. Vectors whose length isn't the most frequent one in
the table take no part either. Repeated rows (equal id and vector) count once.
Equal scores: the smaller vec_id comes first. How many lists a query visits is set by
where the neighbours of sampled vectors stand in the order of all lists, without a
limit: vectors without clusters need most of the lists.
Fewer candidates than k: all are returned, since a query that has less than it
asks for goes on until it has seen all lists. Extra columns are not read; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm.common import cut

SAMPLE, LIST, SEGMENT, QUERIES, CENTRES, EPS = 20_000, 2048, 8192, 4096, 4096, 2.1
#: A round of the search ends at this many times the lists of the one before.
WIDER = 4
#: Ends of the column blocks; the last block takes what is left.
BLOCKS = (24, 40, 56, 128, 256, 512)


def usable(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id and v (array of doubles) of the vectors that take part."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    return rows


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(((c * c).sum(1) - 2 * x[i : i + 4096] @ c.T)).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Space:
    """The lengthened and rotated space and its lists; fixed size, goes to the tasks with the function.

    List c * len(fine) + f has the centre coarse[c] + fine[f].
    """

    def __init__(self, sample: np.ndarray, reach: float, lists: int, centres: int = CENTRES, seed: int = 11):
        self.dim, self.reach = sample.shape[1], reach
        self.turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.dim + 1, self.dim + 1)))[0]
        y = self.rotated(sample)
        self.coarse = kmeans(y, min(lists, centres, len(y)))
        self.fine = np.zeros((1, self.dim + 1))
        if lists > centres:
            left = y - self.coarse[self.to_coarse(y).argmin(1)]
            self.fine = kmeans(left, min(-(-lists // centres), centres, len(left)))
        self.lists = len(self.coarse) * len(self.fine)
        #: So many coarse cells are ranked list by list; those beyond come whole, nearest first.
        self.wide = min(len(self.coarse), 32)

    def rotated(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.reach**2 - (x * x).sum(1), 0))
        return np.hstack([x, more[:, None]]) @ self.turn

    def to_coarse(self, y: np.ndarray) -> np.ndarray:
        """Squared distances to the coarse centres, up to the same constant for a row."""
        return (self.coarse * self.coarse).sum(1) - 2 * y @ self.coarse.T

    def own(self, y: np.ndarray) -> np.ndarray:
        """The list of each vector: its nearest centre's, then the nearest of what is left."""
        out = np.empty(len(y), np.int64)
        for i in range(0, len(y), 4096):
            some = y[i : i + 4096]
            c = self.to_coarse(some).argmin(1)
            left = some - self.coarse[c]
            out[i : i + 4096] = c * len(self.fine) + ((self.fine * self.fine).sum(1) - 2 * left @ self.fine.T).argmin(1)
        return out

    def order(self, y: np.ndarray, most: int) -> np.ndarray:
        """The first `most` lists of each query, nearest first; the same order for any `most`."""
        far = self.to_coarse(y)
        if len(self.fine) == 1:
            return far.argsort(1, kind="stable")[:, :most]
        cells, out = far.argsort(1, kind="stable"), np.empty((len(y), min(most, self.lists)), np.int64)
        for i, row in enumerate(cells):
            centres = self.coarse[row[: self.wide], None, :] + self.fine[None]
            d = ((centres - y[i]) ** 2).sum(2).ravel()
            first = (row[: self.wide, None] * len(self.fine) + np.arange(len(self.fine))).ravel()[d.argsort(kind="stable")][:most]
            more = row[self.wide : self.wide + -(-max(0, most - len(first)) // len(self.fine))]
            out[i] = np.concatenate([first, (more[:, None] * len(self.fine) + np.arange(len(self.fine))).ravel()])[:most]
        return out


    def ranks(self, y: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Where lists (a row a query) stand in their query's order, from 0; no order is spelled out for it."""
        c, f, size = lists // len(self.fine), lists % len(self.fine), len(self.fine)
        far = self.to_coarse(y)
        place = np.empty_like(far, np.int64)
        cells = far.argsort(1, kind="stable")
        np.put_along_axis(place, cells, np.arange(far.shape[1])[None, :], 1)
        out = np.take_along_axis(place, c, 1) * size + f
        if size == 1:
            return out
        for i, row in enumerate(cells):
            d = ((self.coarse[row[: self.wide], None, :] + self.fine[None] - y[i]) ** 2).sum(2).ravel()
            near = np.empty(len(d), np.int64)
            near[d.argsort(kind="stable")] = np.arange(len(d))
            ranked = out[i] < len(d)
            out[i, ranked] = near[out[i, ranked]]
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.values[column.offsets[0].as_py() : column.offsets[-1].as_py()].to_numpy(zero_copy_only=False).reshape(-1, dim) if len(column) else np.empty((0, dim))


class Columns:
    """A segment's rotated vectors in column blocks, with the blocks' squared norms."""

    def __init__(self, y: np.ndarray, blocks: tuple[int, ...] = BLOCKS):
        edges = [0, *[b for b in blocks if b < y.shape[1]], y.shape[1]]
        self.dim = y.shape[1]
        self.spans = list(pairwise(edges))
        self.blocks = [np.ascontiguousarray(y[:, a:b]) for a, b in self.spans]
        self.norm = (self.blocks[0] ** 2).sum(1)


def scan(columns: Columns, queries: np.ndarray, k: int, bounds: np.ndarray | None = None, eps: float = EPS) -> Iterator[np.ndarray]:
    """For each rotated query the rows that may be among its k nearest; the adaptive scan.

    `bounds`: squared distances that a row must not pass (infinite if none is known).
    The first block is one product for all rows and queries. The rows nearest by
    it are measured whole, which bounds the k-th distance; then each block ends
    with the test.
    """
    bounds = np.full(len(queries), np.inf) if bounds is None else bounds
    first, (_, width) = columns.blocks[0], columns.spans[0]
    n = len(first)
    for chunk in range(0, len(queries), 256):
        q = queries[chunk : chunk + 256]
        partial = (q[:, :width] ** 2).sum(1)[:, None] + columns.norm[None, :] - 2 * q[:, :width] @ first.T
        for i, part in enumerate(partial):
            if n <= 4 * k:
                yield np.arange(n)
                continue
            rest = lambda rows, b: ((columns.blocks[b][rows] - q[i, slice(*columns.spans[b])]) ** 2).sum(1)  # noqa: E731, B023
            best = np.argpartition(part, 4 * k)[: 4 * k]
            whole = part[best] + sum(rest(best, b) for b in range(1, len(columns.blocks)))
            bound = min(np.partition(whole, k - 1)[k - 1] + 1e-9, bounds[chunk + i])
            alive, seen = np.arange(n), width
            for b in range(1, len(columns.blocks) + 1):
                # Could the whole distance still be under the bound? At the end: is it?
                slack = (1 + eps / np.sqrt(seen)) ** 2 if seen < columns.dim else 1.0
                keep = part <= bound * (seen / columns.dim) * slack
                alive, part = alive[keep], part[keep]
                if b < len(columns.blocks):
                    part, seen = part + rest(alive, b), columns.spans[b][1]
            yield np.union1d(alive, best[whole <= bound])


def visits_for(space: Space, sample: np.ndarray, k: int, recall: float, tries: int = 200) -> int:
    """Lists to visit for the recall asked for: on the sample, how far down a query's lists its nearest stand."""
    own = space.own(space.rotated(sample))
    q = sample[:: max(1, len(sample) // tries)][:tries]
    top = np.argsort(-(q @ sample.T), 1)[:, 1 : k + 1]
    ranks = np.sort(space.ranks(space.rotated(q, query=True), own[top]).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1


def index(distinct: DataFrame, space: Space) -> DataFrame:
    """`distinct` (v, ids) with its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = space.rotated(_matrix(b.column("v"), space.dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(space.own(y))], names=["v", "ids", "list"])

    return distinct.select("v", "ids").mapInArrow(run, "v array<double>, ids array<bigint>, list long")


def asks(state: DataFrame, space: Space, first: int, last: int) -> DataFrame:
    """`state` (q, v, bound) once for each of a query's lists number first to last - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                b = batch.slice(start, 256)
                lists = space.order(space.rotated(_matrix(b.column("v"), space.dim), query=True), last)[:, first:]
                at = pa.array(np.repeat(np.arange(len(lists)), lists.shape[1]))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("q", "v", "bound")), pa.array(lists.ravel())], names=["q", "v", "bound", "list"])

    return state.select("q", "v", "bound").mapInArrow(run, "q long, v array<double>, bound double, list long")


def meeting(stored: DataFrame, asked: DataFrame, sizes: DataFrame, space: Space, k: int) -> DataFrame:
    """q, ids, score: what each visited list has for its queries, not under their bounds.

    Segments of a list meet pieces of its queries; only lists with more than
    `QUERIES` queries have several pieces, so the copies of stored vectors stay in
    proportion to the visits.
    """
    wanted = asked.groupBy("list").agg(F.count(F.lit(1)).alias("m"))
    plan = cut(sizes.join(wanted, "list").select("list", F.ceil(F.col("n") / SEGMENT).cast("int").alias("segs"), F.ceil(F.col("m") / QUERIES).cast("int").alias("pieces")))
    left = stored.join(plan, "list").withColumn("seg", F.pmod(F.xxhash64("v"), F.col("segs")).cast("int")).withColumn("part", F.explode(F.expr("sequence(0, pieces - 1)")))
    right = asked.join(plan, "list").withColumn("part", F.pmod(F.xxhash64("q"), F.col("pieces")).cast("int")).withColumn("seg", F.explode(F.expr("sequence(0, segs - 1)")))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        x, q = _matrix(left.column("v").combine_chunks(), space.dim), _matrix(right.column("v").combine_chunks(), space.dim)
        name, least = right.column("q").to_numpy(), right.column("bound").to_numpy()
        ids, out = left.column("ids").combine_chunks(), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        most = min(k + 1, len(x))
        if most and len(q):
            bounds = (q * q).sum(1) + space.reach**2 - 2 * least
            bounds += 1e-9 * (1 + np.where(np.isfinite(bounds), np.abs(bounds), 0))
            for i, c in enumerate(scan(Columns(space.rotated(x)), space.rotated(q, query=True), most, bounds)):
                s = (x[c] * q[i]).sum(1)
                keep = s >= least[i]
                if keep.sum() > most:
                    keep &= s >= np.partition(s, len(s) - most)[len(s) - most]
                out.append((np.full(int(keep.sum()), name[i]), c[keep], s[keep]))
        names, rows, scores = (np.concatenate(o) for o in zip(*out, strict=True))
        return pa.table({"q": pa.array(names, pa.int64()), "ids": ids.take(pa.array(rows)), "score": scores})

    keys = ["list", "seg", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "q long, ids array<bigint>, score double")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", recall: float = 0.96, list_rows: int = LIST, centres: int = CENTRES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest, its own id excluded.

    `recall`: sets how many lists a query visits, by the sample; vectors without
    clusters need most lists, clustered ones few.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = usable(rows, id_col, vector)
    shape = base.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("long"))
    top = shape.orderBy(F.desc("n"), "dim").first()
    if top is None:
        return empty
    dim, reach = top["dim"], float(np.sqrt(top["long"]))
    base = base.filter(F.size("v") == dim)
    # One row per distinct vector with its k + 1 smallest ids: the rank's limit is applied before the shuffle, too.
    same = W.partitionBy("v").orderBy("id")
    few = base.withColumn("r", F.dense_rank().over(same)).filter(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    sample = base.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    picked = np.array(sample["v"].tolist(), np.float64).reshape(-1, dim)
    space = Space(picked, reach, max(1, top["n"] // list_rows), centres)
    stored = cut(index(few, space))
    sizes = cut(stored.groupBy("list").agg(F.count(F.lit(1)).alias("n")))
    asked = usable(queries, id_col, vector).filter(F.size("v") == dim)
    # Equal query vectors ask once, under their smallest id.
    once = cut(asked.groupBy("v").agg(F.min("id").alias("q")).select("q", "v"))

    visits, first, last = visits_for(space, picked, k, recall), 0, 1
    best = None
    while first < space.lists:
        state = once.withColumn("bound", F.lit(float("-inf"))) if best is None else once.join(best, "q", "left").select("q", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
        if first >= visits:  # only those that lack neighbours go on
            state = cut(state.filter(F.col("bound") == float("-inf")))
            if state.isEmpty():
                break
        else:
            last = min(last, visits)
        found = meeting(stored, asks(state, space, first, last), sizes, space, k).select("q", F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("i")))).alias("c"))
        if best is not None:
            found = found.unionByName(best.select("q", F.explode("c").alias("c")))
        # The rank's limit is applied before the shuffle, too; the bound is the score of the last of k + 1 ids.
        ranked = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("c.s", "c.i"))).filter(F.col("r") <= k + 1)
        best = ranked.groupBy("q").agg(F.array_sort(F.collect_list("c")).alias("c"))
        best = cut(best.select("q", "c", F.when(F.size("c") > k, -F.element_at("c", -1)["s"]).otherwise(float("-inf")).alias("bound")))
        first, last = last, min(space.lists, last * WIDER)
    each = asked.distinct().join(once, "v").select("id", "q").join(best, "q").select(F.col("id").alias("query_id"), F.slice(F.filter("c", lambda x: x["i"] != F.col("id")), 1, k).alias("c"))
    return each.select("query_id", F.posexplode("c")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.i").alias("vec_id"), (-F.col("col.s")).alias("score"))
