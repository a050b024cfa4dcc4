"""Token ids as length-delimited binary records, with an offset index beside each file.

A record is: the payload's length (unsigned 64-bit), its masked CRC-32C, the payload,
the payload's masked CRC-32C; all little-endian. A payload is a head (bytes an id, 1 if
doc_id is null, doc_id) and the ids, in two bytes each where the vocabulary has no more
than 65,536 entries, else in four. `<file>.idx` holds, for each record and for the end of
the file, the offset and the number of ids before it (unsigned 64-bit each), so that a
record is found by two reads, in any order. `manifest` is a Parquet table of one row a
file; only files that it names count, so a lost or repeated task leaves no rows.

Rows are written in ascending doc_id order, null last, equal ids by their text's hash; rows
that repeat are records of their own. A null or empty text gives the end id alone. A text
of any length is one record, encoded whole; what a task holds is bounded by its longest
text. An empty table gives a manifest without rows. Extra columns, whatever their names,
are not read. Files go through pyarrow's file systems, so the folder can be on any store
that those reach.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "file_no int, file string, records long, tokens long, bytes long"
RECORDS = "doc_id long, start long, n_tokens long, token_ids binary"
#: Fixed values of the record format: CRC-32C's reflected polynomial and the constant of masked sums.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
HEAD = "<HHq"
ENTRY = np.dtype([("offset", "<u8"), ("before", "<u8")])
#: Records are made and read in runs of about so many characters or bytes.
RUN = 1 << 21
#: Bytes of a file that one read task gets.
SPLIT = 64 << 20
MEMO = 500_000
#: Words that one call of the library gets.
GROUP = 256


class Checksum:
    """CRC-32C of many byte strings at once.

    The sum is linear: two neighbouring stretches make one by advancing the left one's
    value over as many zero words as the right one has. So all strings are halved
    together, level by level, each level one table look-up an element.
    """

    def __init__(self):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1)
        self.byte = step
        column = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(4):
            column = step[column & 255] ^ (column >> 8)
        self.levels = [self._table(column)]

    @staticmethod
    def _table(column: np.ndarray) -> np.ndarray:
        """What each value of each of the four bytes gives, from what each bit gives."""
        bits = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(bool)
        return np.stack([np.bitwise_xor.reduce(np.where(bits, column[8 * k : 8 * k + 8], np.uint32(0)), 1) for k in range(4)])

    def _advance(self, level: int, x: np.ndarray) -> np.ndarray:
        while level >= len(self.levels):
            last = len(self.levels) - 1
            self.levels.append(self._table(self._advance(last, self._advance(last, np.uint32(1) << np.arange(32, dtype=np.uint32)))))
        t, b = self.levels[level], np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4)
        return t[0][b[:, 0]] ^ t[1][b[:, 1]] ^ t[2][b[:, 2]] ^ t[3][b[:, 3]]

    def _short(self, data: bytes) -> int:
        s = 0xFFFFFFFF
        for b in data:
            s = int(self.byte[(s ^ b) & 255]) ^ (s >> 8)
        return s ^ 0xFFFFFFFF

    def of(self, data: list[bytes]) -> np.ndarray:
        size = np.array([len(x) for x in data], np.int64)
        out = np.zeros(len(data), np.uint32)
        for i in np.flatnonzero(size < 4):
            out[i] = self._short(data[i])
        long = np.flatnonzero(size >= 4)
        if not len(long):
            return out
        # Zeros in front of a string change nothing; its first four bytes take the start value.
        pad = -size[long] % 4
        flat = np.frombuffer(b"".join([part for i, p in zip(long.tolist(), pad.tolist(), strict=True) for part in (b"\0" * p, data[i])]), np.uint8).copy()
        count = (size[long] + pad) // 4
        start = np.cumsum(count) - count
        flat[(start * 4 + pad)[:, None] + np.arange(4)] ^= 255
        v, level = flat.view("<u4"), 0
        while count.max() > 1:
            odd = (count & 1).astype(bool)
            v = np.insert(v, (np.cumsum(count) - count)[odd], 0)
            v = self._advance(level, v[0::2]) ^ v[1::2]
            count, level = (count + 1) // 2, level + 1
        out[long] = self._advance(0, v) ^ np.uint32(0xFFFFFFFF)
        return out

    def masked(self, data: list[bytes]) -> np.ndarray:
        s = self.of(data)
        return ((s >> np.uint32(15)) | (s << np.uint32(17))) + np.uint32(MASK)


class WordEncoder:
    """Ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit integers.

    A tokenizer that drops white space before its merges encodes each run between
    white space by itself; such runs are encoded once (many at a call) and kept in
    two generations of at most MEMO each. Any other tokenizer gets whole texts.
    """

    BLANK = str.maketrans("\t\n\r", "   ")

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.new, self.old = Tokenizer.from_str(spec), {}, {}
        self.by_run = self._drops_space(spec)
        self.lowers = '"Lowercase"' in spec
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    @staticmethod
    def _drops_space(spec: str) -> bool:
        import json

        s = json.loads(spec)
        before = (s.get("pre_tokenizer") or {}).get("pretokenizers", [s.get("pre_tokenizer") or {}])
        first = before[0]
        matched = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
        drops = first.get("type") == "WhitespaceSplit" or (matched and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "").split("|") and r"\s+" not in first["pattern"]["Regex"].split("|"))
        plain = {"NFC", "Replace", "Lowercase"} >= {n.get("type") for n in (s.get("normalizer") or {}).get("normalizers", [])}
        return bool(drops and plain and s["model"]["type"] == "BPE" and not s.get("post_processor") and not any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["content"][-1] in ".,;:!?" for t in s["added_tokens"]))

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, found: list[str]) -> list[bytes]:
        """Runs of letters many at a time, parted where a token ends a word; whatever gives another number of ends than runs goes alone."""
        groups = [found[k : k + GROUP] for k in range(0, len(found), GROUP)]
        out = []
        for group, data in zip(groups, self._encoded([" ".join(g) for g in groups]), strict=True):
            edges = np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) * 4 + 4
            if len(edges) != len(group):
                out += self._encoded(group)
                continue
            edges = [0, *edges.tolist()]
            out += [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out

    def _small(self, run: str) -> str:
        """The run in small letters where that changes no id: both composed, no letter that depends on its place, no added token."""
        low = run.lower()
        if low == run or not self.lowers or "\u03a3" in run or any(t in low for t in self.added):
            return run
        composed = run.isascii() or (unicodedata.is_normalized("NFC", run) and unicodedata.is_normalized("NFC", low))
        return low if composed else run

    def _learn(self, runs: set[str]) -> None:
        if len(self.new) >= MEMO:
            self.old, self.new = self.new, {}
        unknown = runs.difference(self.new)
        known = [r for r in unknown if r in self.old]
        self.new.update((r, self.old[r]) for r in known)
        unknown.difference_update(known)
        # A mark after what stays a letter is always a match of its own, so the run before it is looked up.
        cut = {r for r in unknown if len(r) > 1 and r[-1] in ".,;:!?" and (r[-2].isalpha() if r[-2].isascii() else unicodedata.normalize("NFC", r[-2]).lower()[-1].isalpha())}
        bare = (unknown - cut | {r[:-1] for r in cut} | {r[-1] for r in cut}).difference(self.new)
        # A run and its small letters have the same ids.
        small = {r: low for r in bare if (low := self._small(r)) != r}
        ask = list((bare - small.keys()).union(small.values()).difference(self.new))
        letters = [r for r in ask if r.isalpha()] if self.ends.any() else []
        self.new.update(zip(letters, self._words(letters), strict=True))
        other = [r for r in ask if r not in self.new]
        self.new.update(zip(other, self._encoded(other), strict=True))
        self.new.update((r, self.new[low]) for r, low in small.items())
        self.new.update((r, self.new[r[:-1]] + self.new[r[-1]]) for r in cut)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_run:
            return self._encoded(texts)
        runs = [t.translate(self.BLANK).split(" ") if ("\t" in t or "\r" in t) else t.replace("\n", " ").split(" ") for t in texts]
        self._learn(set().union(*runs))
        find = self.new.__getitem__
        return [b"".join(map(find, r)) for r in runs]


_kept: dict[str, object] = {}


def kept(kind, key: str, make):
    """One object of a kind per Python worker."""
    if _kept.get(kind, (None,))[0] != key:
        _kept[kind] = (key, make())
    return _kept[kind][1]


def place(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)


def runs(sizes: list[int], most: int = RUN) -> Iterator[tuple[int, int]]:
    """Borders of runs of items of about `most` in all."""
    start = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2) -> None:
    """Encode `docs` (doc_id, text) and write files, indexes and the manifest under `path`.

    The tokenizer's file is broadcast; its size is that of the vocabulary. Texts are
    dealt into ranges of doc_id by one shuffle; a file is one range.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    shared, key = spark.sparkContext.broadcast(spec), vocabulary
    store, root = place(path)
    store.create_dir(root, recursive=True)
    keys = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc(), F.col("tie").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept("words", key, lambda: WordEncoder(shared.value))
        sums = kept("sums", "", Checksum)
        wide = encoder.tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        kind, end = ("<u4", 4) if wide else ("<u2", 2), np.array([end_id], "<u4").tobytes()
        store, root = place(path)
        no = TaskContext.get().partitionId()
        name = f"part-{no:06d}-{uuid.uuid4().hex}.rec"
        data = index = None
        at = records = tokens = 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in runs([len(t) for t in texts]):
                if data is None:
                    data, index = store.open_output_stream(f"{root}/{name}"), store.open_output_stream(f"{root}/{name}.idx")
                packed = [np.frombuffer(x + end, "<u4") for x in encoder.encode(texts[a:b])]
                payloads = [struct.pack(HEAD, kind[1], i is None, i or 0) + x.astype(kind[0]).tobytes() for i, x in zip(ids[a:b], packed, strict=True)]
                sizes = [struct.pack("<Q", len(p)) for p in payloads]
                lines = np.zeros(b - a, ENTRY)
                lines["offset"] = at + np.cumsum([0, *(len(p) + 16 for p in payloads)])[:-1]
                lines["before"] = tokens + np.cumsum([0, *map(len, packed)])[:-1]
                index.write(lines.tobytes())
                marks = zip(sizes, sums.masked(sizes).astype("<u4"), payloads, sums.masked(payloads).astype("<u4"), strict=True)
                block = b"".join([part for s, c, p, d in marks for part in (s, c.tobytes(), p, d.tobytes())])
                data.write(block)
                at, records, tokens = at + len(block), records + b - a, tokens + sum(map(len, packed))
        if data is not None:
            index.write(np.array([(at, tokens)], ENTRY).tobytes())
            data.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([no], pa.int32()), "file": [name], "records": [records], "tokens": [tokens], "bytes": [at]})

    written = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(run, MANIFEST)
    written.write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, with the number of records and ids before it; rows are few, one a file."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return files.withColumn("records_before", F.coalesce(F.sum("records").over(before), F.lit(0))).withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _parsed(block: bytes, edges: np.ndarray, sums: Checksum, where: str) -> list[tuple]:
    """(doc_id, packed ids) of the records that lie at `edges` of a block; wrong lengths and sums raise an error."""
    view = memoryview(block)
    parts = [bytes(view[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    heads, bodies = [p[:8] for p in parts], [p[12:-4] for p in parts]
    right = np.array([struct.unpack("<Q", h)[0] if len(p) >= 16 else -1 for h, p in zip(heads, parts, strict=True)]) == np.array([len(b) for b in bodies])
    if not right.all():
        raise ValueError(f"{where}: record {int(np.argmin(right))} of the run has another length than its index says")
    right = (sums.masked(heads) == np.frombuffer(b"".join(p[8:12] for p in parts), "<u4")) & (sums.masked(bodies) == np.frombuffer(b"".join(p[-4:] for p in parts), "<u4"))
    if not right.all():
        raise ValueError(f"{where}: record {int(np.argmin(right))} of the run has a wrong checksum")
    out = []
    for body in bodies:
        width, null, doc_id = struct.unpack_from(HEAD, body)
        ids = body[struct.calcsize(HEAD) :]
        out.append((None if null else doc_id, ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()))
    return out


def _batch(found: list[tuple], starts, extra: dict | None = None) -> pa.RecordBatch:
    ids = [x for _, x in found]
    return pa.RecordBatch.from_pydict((extra or {}) | {"doc_id": pa.array([i for i, _ in found], pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "token_ids": pa.array(ids, pa.binary())})


def load(spark: SparkSession, path: str) -> DataFrame:
    """All records: doc_id, start (ids before the record), n_tokens and token_ids (4 bytes an id).

    A file is cut at record borders into parts of about SPLIT bytes, dealt over the tasks.
    """
    files = manifest(spark, path).withColumn("parts", F.ceil(F.col("bytes") / SPLIT).cast("long"))
    parts = files.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    edge = lambda k: F.floor(F.col("records") * k / F.col("parts"))
    parts = parts.select("file", "start", edge(F.col("part")).alias("first"), edge(F.col("part") + 1).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = place(path)
        sums = kept("sums", "", Checksum)
        for row in (r for batch in batches for r in batch.to_pylist()):
            with store.open_input_file(f"{root}/{row['file']}.idx") as f:
                f.seek(row["first"] * ENTRY.itemsize)
                lines = np.frombuffer(f.read((row["last"] - row["first"] + 1) * ENTRY.itemsize), ENTRY)
            at = lines["offset"].astype(np.int64)
            with store.open_input_file(f"{root}/{row['file']}") as f:
                for a, b in runs(np.diff(at).tolist()):
                    f.seek(int(at[a]))
                    found = _parsed(f.read(int(at[b] - at[a])), at[a : b + 1] - at[a], sums, f"{row['file']} from record {row['first'] + a}")
                    yield _batch(found, row["start"] + lines["before"][a:b].astype(np.int64))

    # One row a part; dealt by a hash of the file and the part, since the window has left them in one partition.
    return parts.repartition(spark.sparkContext.defaultParallelism * 4, "file", "first").mapInArrow(run, RECORDS)


def shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All records in a seeded random order: position's sort key `place`, then as `load`.

    References (file, record) are sorted by a keyed hash; each task fetches its
    stretch of the order by the index, two reads a record, and no record is moved
    by a shuffle.
    """
    refs = manifest(spark, path).select("file_no", "file", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1)).alias("record"))
    refs = refs.withColumn("place", F.xxhash64(F.lit(seed), "file_no", "record")).repartitionByRange("place", "file_no", "record").sortWithinPartitions("place", "file_no", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = place(path)
        sums = kept("sums", "", Checksum)
        open_files: dict[str, tuple] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] not in open_files:
                    while len(open_files) >= 64:
                        for f in open_files.pop(next(iter(open_files))):
                            f.close()
                    open_files[row["file"]] = (store.open_input_file(f"{root}/{row['file']}.idx"), store.open_input_file(f"{root}/{row['file']}"))
                index, data = open_files[row["file"]]
                index.seek(row["record"] * ENTRY.itemsize)
                lines = np.frombuffer(index.read(2 * ENTRY.itemsize), ENTRY)
                at = lines["offset"].astype(np.int64)
                data.seek(int(at[0]))
                found = _parsed(data.read(int(at[1] - at[0])), at - at[0], sums, f"{row['file']} record {row['record']}")
                yield _batch(found, [row["start"] + int(lines["before"][0])], {"place": pa.array([row["place"]], pa.int64())})

    return refs.mapInArrow(run, f"place long, {RECORDS}")

