"""Byte-level BPE by dynamic programming over prefixes.

For a fixed list of ranks the BPE encoding of every byte prefix is unique, so
each prefix has one last token. `PrefixTable.extend` finds it from the prefixes
before: among the tokens that end the prefix, exactly one both ends a valid
encoding and is compatible with the last token of what stands before it. The
stored last tokens make appends exact (only the new bytes are worked on) and let
an edit keep everything before it and everything after the next point at which
the old and the new piece boundaries meet (`Encoding`).

The tokens that end each prefix come from one Aho-Corasick automaton of the
vocabulary, longest first. Short pieces are remembered with their packed ids, in
two generations, so that frequent ones stay when the memo is full.

Column operators: `encode`, `decode`, `coded` (both in one pass), `append`.
Nulls count as empty texts. Very long texts are one row's work; memory is in
proportion to the row. Repeated rows, ties and extra columns pass through; a
column named like a new one is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Pieces up to this many characters are remembered, at most so many per task.
MEMO_CHARS, MEMO_PIECES = 48, 300_000
#: Remembered answers to whether two tokens keep their border.
MEMO_PAIRS = 1_000_000
#: A match of the pattern looks at fewer than this many characters beyond its end (contractions and white space look at two).
LOOK = 3


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: base64 token, blank, rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixTable:
    """Everything that is derived once from the ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        self.token: list[bytes | None] = [None] * size
        for t, i in ranks.items():
            self.token[i] = t
        self.left, self.right = [-1] * size, [-1] * size
        self.merged: dict[int, int] = {}
        self.ending = ahocorasick.Automaton()
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) > 1:
                last = self._last_merge(t, i)
                if last is None:
                    continue  # no sequence of merges gives it; only a whole piece can be it
                self.left[i], self.right[i] = last
                self.merged[last[0] << 32 | last[1]] = i
            self.ending.add_word(t.decode("latin-1"), (len(t), i))
        if len(self.ending):
            self.ending.make_automaton()
        self.longest = max(map(len, ranks), default=0)
        self._fits: dict[int, bool] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge completes `token` when it is encoded alone."""
        units = [token[k : k + 1] for k in range(len(token))]
        if any(u not in self.ranks for u in units):
            return None
        while len(units) > 2:
            best, at = rank, -1
            for k in range(len(units) - 1):
                r = self.ranks.get(units[k] + units[k + 1], rank)
                if r < best:
                    best, at = r, k
            if at < 0:
                return None
            units[at : at + 2] = [units[at] + units[at + 1]]
        return self.ranks[units[0]], self.ranks[units[1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border when the two tokens' bytes stand side by side."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= MEMO_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # Undo the merges on both sides from the latest to the earliest. The border
        # falls if, at some time, the units at it merge before the next merge of
        # either side; on equal ranks the left-hand merge happens first.
        merged, last, first = self.merged.get, self.right, self.left
        until = none = len(self.token) * 4
        while True:
            if merged(left << 32 | right, none) < until:
                return False
            if left > right:
                until, inner = left, last[left]
                if inner >= 0:
                    left = inner
                    continue
                until, inner = right + 1, first[right]
                if inner < 0:
                    return True
                right = inner
            else:
                until, inner = right + 1, first[right]
                if inner >= 0:
                    right = inner
                    continue
                until, inner = left, last[left]
                if inner < 0:
                    return True
                left = inner

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Append to `last` the last token of each prefix of `piece` that is longer than it."""
        if len(last) == len(piece):
            return last
        # Tokens that end beyond what is known start at most a longest token before it.
        pairs, found = self._fits.get, len(last) - 1
        for end, (size, t) in self.ending.iter(piece.decode("latin-1"), max(0, len(last) - self.longest)):
            if end <= found:
                continue  # its last token is known
            start = end + 1 - size
            if start:
                before = last[start - 1]
                holds = pairs(before << 32 | t)
                if not (self.fits(before, t) if holds is None else holds):
                    continue
            last.append(t)
            found = end
        if len(last) != len(piece):
            raise ValueError("the vocabulary lacks a single byte")
        return last

    def ids(self, piece: bytes, last: list[int]) -> list[int]:
        out, end = [], len(piece)
        while end:
            t = last[end - 1]
            out.append(t)
            end -= len(self.token[t])
        return out[::-1]

    def piece_ids(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.ids(piece, self.extend(piece, []))


class Encoding:
    """A text with its pieces and, for each, the last token of every prefix."""

    def __init__(self, tables: PrefixTable, pattern: str, text: str = ""):
        self.tables, self.pattern, self.text = tables, regex.compile(pattern), text
        self.pieces: list[tuple[int, int, bytes, list[int]]] = []
        self._scan(0, [], 0)

    def _scan(self, start: int, after: list, shift: int) -> None:
        """Cut pieces from `start`; stop where an old piece of `after` starts at the same place."""
        old = {p[0] + shift: k for k, p in enumerate(after)}
        for m in self.pattern.finditer(self.text, start):
            if m.start() in old:
                k = old[m.start()]
                a, b, piece, last = after[k]
                if m.end() == b + shift:
                    self.pieces += [(x[0] + shift, x[1] + shift, *x[2:]) for x in after[k:]]
                    return
            piece = m.group().encode()
            self.pieces.append((m.start(), m.end(), piece, self.tables.extend(piece, [])))

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]; pieces away from the edit keep their stored tokens."""
        # A match looks at fewer than LOOK characters beyond its end, so a piece that
        # ends that far before `start` stays as it is; matches never look back.
        keep = 0
        while keep < len(self.pieces) and self.pieces[keep][1] + LOOK <= start:
            keep += 1
        rest = self.pieces[keep:]
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        self.pieces = self.pieces[:keep]
        begin = self.pieces[-1][1] if self.pieces else 0
        first = rest[0] if rest else None
        had = len(self.pieces)
        self._scan(begin, [p for p in rest if p[0] >= end], shift)
        if first and len(self.pieces) > had:  # the touched piece shares a prefix with the old one
            a, b, piece, last = self.pieces[had]
            same = 0
            for x, y in zip(piece, first[2], strict=False):
                if x != y:
                    break
                same += 1
            self.pieces[had] = (a, b, piece, self.tables.extend(piece, first[3][:same]))

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        out: list[int] = []
        for _, _, piece, last in self.pieces:
            whole = self.tables.ranks.get(piece)
            out += [whole] if whole is not None else self.tables.ids(piece, last)
        return out


class Encoder(dict):
    """Encodes whole texts; remembers the packed ids of short pieces."""

    def __init__(self, tables: PrefixTable, pattern: str):
        super().__init__()
        self.tables, self.find, self.old = tables, regex.compile(pattern).findall, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = packed(self.tables.piece_ids(piece.encode()))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got

    def packed_ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))


class Decoder:
    """The bytes of many texts' packed ids at once: one take from the column of tokens."""

    def __init__(self, tables: PrefixTable):
        self.tokens = pa.array([t or b"" for t in tables.token], pa.large_binary())

    def texts(self, data: list[bytes]) -> list[bytes]:
        ids = pa.array(np.frombuffer(b"".join(data), "<u4"))
        found = self.tokens.take(ids)
        ends = np.cumsum([0, *[len(x) // 4 for x in data]])
        at = np.frombuffer(found.buffers()[1], np.int64)[: len(ids) + 1][ends]
        whole = memoryview(found.buffers()[2] or b"")
        return [bytes(whole[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def packed(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def unpacked(data: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(data) // 4}I", data)


_tables: dict[object, PrefixTable] = {}


def _tables_of(shared) -> PrefixTable:
    """Built once per Python worker from the broadcast ranks."""
    if shared.id not in _tables:
        _tables.clear()
        _tables[shared.id] = PrefixTable(shared.value)
    return _tables[shared.id]


class _Shared:
    def __init__(self, spark: SparkSession, path: str):
        self.cast, self.id = spark.sparkContext.broadcast(read_ranks(path)), path

    @property
    def value(self):
        return self.cast.value


def _fresh(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names the operator's own columns take."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


#: Texts of a batch are worked on in runs of about so many characters, which bounds what a task holds besides its batch.
RUN_CHARS = 1 << 20


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Borders of runs of texts of about RUN_CHARS characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= RUN_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts) or not texts:
        yield start, len(texts)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "token_ids", keep_text: bool = False) -> DataFrame:
    """Add `ids` (binary, 4 bytes little-endian per token) and `n_tokens`; the text goes unless kept.

    The ranks (some 50,000 entries, bounded by the vocabulary) are broadcast.
    A column that already has one of the two new names is replaced.
    """
    shared = _Shared(df.sparkSession, vocabulary)
    df = _fresh(df, *({ids, "n_tokens"} - {text}))
    rest = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*rest, T.StructField(ids, T.BinaryType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_tables_of(shared), pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            for a, b in _runs(texts):
                data = [encoder.packed_ids(x) for x in texts[a:b]]
                cols = [batch.column(f.name).slice(a, b - a) for f in rest]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(data, pa.binary()), pa.array([len(x) // 4 for x in data], pa.int64())], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add `out` (binary): the bytes of the tokens in `ids`."""
    shared = _Shared(df.sparkSession, vocabulary)
    df = _fresh(df, out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(_tables_of(shared))
        for batch in batches:
            data = decoder.texts([x or b"" for x in batch.column(ids).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def coded(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode and decode in one pass: n_tokens and digests of ids and decoded bytes in place of the text.

    Checks a vocabulary on a corpus without moving ids between workers and Spark.
    """
    shared = _Shared(df.sparkSession, vocabulary)
    own = ("n_tokens", "ids_sha256", "decoded_sha256")
    rest = [f for f in df.schema.fields if f.name != text and f.name.lower() not in own]
    schema = T.StructType([*rest, T.StructField(own[0], T.LongType()), *[T.StructField(c, T.StringType()) for c in own[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables_of(shared)
        encoder, decoder = Encoder(tables, pattern), Decoder(tables)
        digest = lambda data: pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string())
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            for a, b in _runs(texts):
                data = [encoder.packed_ids(x) for x in texts[a:b]]
                cols = [batch.column(f.name).slice(a, b - a) for f in rest]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([len(x) // 4 for x in data], pa.int64()), digest(data), digest(decoder.texts(data))], names=schema.names)

    return df.select(text, *[f.name for f in rest]).mapInArrow(run, schema)


def append(df: DataFrame, vocabulary: str, pattern: str, more: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add `ids` for text followed by column `more`, by exact appends to the stored prefixes."""
    shared = _Shared(df.sparkSession, vocabulary)
    df = _fresh(df, ids)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables_of(shared)
        for batch in batches:
            data = []
            for a, b in zip(batch.column(text).to_pylist(), batch.column(more).to_pylist(), strict=True):
                state = Encoding(tables, pattern, a or "")
                state.append(b or "")
                data.append(packed(state.ids()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encode, decode, and keep only digests of both."""
    return coded(df.select("doc_id", "text"), vocabulary, pattern)
