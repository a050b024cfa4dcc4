"""Personal data by patterns and a skip-chain conditional random field.

Base spans (email, ip, card, phone) come from fixed patterns. The field has a
node for each token with a digit or an @; neighbouring nodes share a chain
potential, and each node and the document's first one that it repeats (same
digits, or same letters apart from case and punctuation) share a skip potential,
so repeats are two steps apart however far they stand. So do a base span and each
token that has all its digits or at least its last seven. Nodes inside base spans are
observed. Loopy message passing, for each document until its messages change by
less than `TOLERANCE` (or `ROUNDS` rounds, should they swing), gives the others'
marginals; tokens that are very likely of a kind are added, neighbours of one
kind as one span, so a number that stands in full in one place is also found
where it is shortened or written apart.

Training: pseudo-likelihood on nodes of at most `SAMPLE` documents (lowest hashes
of doc_id), labelled by the base spans, with priors that draw skip potentials
towards agreement. What reaches the driver are counts of distinct nodes.

Offsets are code points, ends exclusive. Texts of any length are read whole, in
time near their length. Nulls: a null text counts as empty. At equal marginals the
kind listed first is taken. Repeated rows get equal results, whatever stands in the
same batch; empty tables give empty ones; columns that clash with the result's are
replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE, SURE, ROUNDS, TOLERANCE = 4000, 0.95, 500, 1e-4
KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. A match always starts where its run of digits starts, which the look-behinds say at once.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
WHITE, BLANK = "\x20\x09\x0a\x0b\x0c\x0d", re.compile(r"[\x20\x09-\x0D]")
DIGITS = str.maketrans("", "", "".join(map(chr, range(48))) + "".join(map(chr, range(58, 128))))
TRIM = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """For each @ the run of local characters before it and the domain behind it."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        floor = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    if not HINT.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


FEATURES = 20


def features(token: str) -> int:
    """The token's shape as a bit set."""
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    dots = token.count(".")
    bits = ["@" in token, digits == 0, 1 <= digits <= 2, digits == 3, digits == 4, 5 <= digits <= 6, 7 <= digits <= 8, 9 <= digits <= 12, 13 <= digits <= 19, digits > 19, letters == 0, letters > 0 and digits > 0, token[0] == "+", "(" in token or ")" in token, "-" in token, dots == 1, dots == 3, len(token) > 12, "/" in token or ":" in token or "=" in token, True]
    return sum(b << i for i, b in enumerate(bits))


def hinted(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each token with a digit or an @; every character is passed a few times at most."""
    at = 0
    while m := HINT.search(text, at):
        start = max(at, *(text.rfind(c, at, m.start()) + 1 for c in WHITE))
        end = BLANK.search(text, m.end())
        at = end.start() if end else len(text)
        yield start, at


def nodes(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Nodes (start, end, features, observed label or 0), chain edges and skip edges."""
    by_start = sorted((a, b, k + 1) for k, a, b in spans)
    starts = [s[0] for s in by_start]
    out, chain, skip, first, digits_of = [], [], [], {}, []
    for a, b in hinted(text):
        word = text[a:b]
        left = len(word) - len(word.lstrip(TRIM.replace("(", "")))
        right = len(word.rstrip(TRIM.replace(")", "")))
        if left >= right:
            left, right = 0, len(word)
        a, b, word = a + left, a + right, word[left:right]
        i = bisect_right(starts, b - 1) - 1
        label = next((k for s, e, k in by_start[max(0, i - 3) : i + 1] if s < b and e > a), 0)
        n = len(out)
        if out and text[out[-1][1] : a].strip(TRIM + " \n") == "" and a - out[-1][1] <= 4:
            chain.append((n - 1, n))
        digits = word.translate(DIGITS)
        key = digits if len(digits) >= 3 else word.strip(TRIM).lower()
        if first.setdefault(key, n) != n:
            skip.append((first[key], n))
        out.append((a, b, features(word), label))
        digits_of.append(digits)
    # Numbers that a base span writes with blanks or a prefix, which other places leave out:
    # looked up by length and remainder, so that no suffix is stored, and compared where found.
    ends, tails = [x[1] for x in out], {}
    asked = {len(d) for d in digits_of if len(d) >= 7} if by_start else set()
    for a, b, _ in by_start:
        digits, n = text[a:b].translate(DIGITS), bisect_right(ends, a)
        for size, rest in remainders(digits):
            if size in asked:
                tails.setdefault((size, rest), (n, digits))
    for n, digits in enumerate(digits_of if tails else ()):
        if out[n][3] or len(digits) < 7:
            continue
        *_, last = remainders(digits)
        hub, whole = tails.get(last, (n, digits))
        if hub != n and first.get(digits) != hub and whole.endswith(digits):
            skip.append((hub, n))
    return out, chain, skip


PRIME, BASE = (1 << 61) - 1, 1 << 21


def remainders(digits: str) -> Iterator[tuple[int, int]]:
    """Length and remainder of each tail of a text of digits, shortest first, in one pass; any letter is a digit to a large base."""
    rest, place = 0, 1
    for size, d in enumerate(reversed(digits), 1):
        rest, place = (rest + (ord(d) + 1) * place) % PRIME, place * BASE % PRIME
        yield size, rest


class Field:
    """Weights: unary [features x 5], chain [5 x 5] and skip [5 x 5], all log potentials."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, feats: np.ndarray, observed: np.ndarray, chain: np.ndarray, skip: np.ndarray, owner: np.ndarray | None = None, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product; all messages of a round at once, damped, for each document (`owner` of a node) until they stand still."""
        x = ((feats[:, None] >> np.arange(FEATURES)) & 1).astype(float)
        phi = x @ self.unary
        seen = observed > 0
        phi[seen] = -30.0
        phi[seen, observed[seen]] = 0.0
        owner = np.zeros(len(feats), np.int64) if owner is None else owner
        src = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]]).astype(int)
        dst = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]]).astype(int)
        c, s = len(chain), len(skip)
        back = np.concatenate([np.arange(c) + c, np.arange(c), np.arange(s) + 2 * c + s, np.arange(s) + 2 * c])
        kind = np.repeat([0, 1, 2, 3], [c, c, s, s])
        table = np.stack([self.chain, self.chain.T, self.skip, self.skip.T])
        msg = np.zeros((len(src), 5))
        belief, doc = phi.copy(), owner[src]
        live = np.arange(len(src))
        for _ in range(rounds):
            if not len(live):
                break
            new = np.logaddexp.reduce((belief[src[live]] - msg[back[live]])[:, :, None] + table[kind[live]], axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            new = 0.7 * new + 0.3 * msg[live]
            change = np.zeros(int(owner.max()) + 1)
            np.maximum.at(change, doc[live], np.abs(new - msg[live]).max(1))
            np.add.at(belief, dst[live], new - msg[live])
            msg[live] = new
            live = live[change[doc[live]] >= TOLERANCE]
        belief = phi.copy()
        np.add.at(belief, dst, msg)
        belief -= belief.max(1, keepdims=True)
        p = np.exp(belief)
        return p / p.sum(1, keepdims=True)


def _prior() -> Field:
    return Field(np.zeros((FEATURES, 5)), np.eye(5) * 0.8, np.eye(5) * 3.0)


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Penalised pseudo-likelihood: a softmax of the features and the neighbours' labels."""
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id"))
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                if not text or not HINT.search(text):
                    continue
                found, chain, skip = nodes(text, base_spans(text))
                near = [[0] * 10 for _ in found]
                for edges, at in ((chain, 0), (skip, 5)):
                    for i, j in edges:
                        near[i][at + found[j][3]] = 1
                        near[j][at + found[i][3]] = 1
                rows += [(f[2], f[3], sum(v << i for i, v in enumerate(n))) for f, n in zip(found, near, strict=True)]
            f, y, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(y, pa.int32()), pa.array(n, pa.int32())], names=["f", "y", "n"])

    counts = held.mapInArrow(run, "f int, y int, n int").groupBy("f", "y", "n").agg(F.count(F.lit(1)).alias("m")).toPandas()
    prior = _prior()
    w0 = np.concatenate([prior.unary, prior.chain, prior.skip])
    if not len(counts):
        w0[FEATURES - 1, 0] = 4.0
        return Field(w0[:FEATURES], w0[FEATURES : FEATURES + 5], w0[FEATURES + 5 :])
    bits = lambda v, k: ((v.to_numpy()[:, None] >> np.arange(k)) & 1).astype(float)
    x = np.hstack([bits(counts["f"], FEATURES), bits(counts["n"], 10)])
    y, m = np.eye(5)[counts["y"].to_numpy()], counts["m"].to_numpy(float)
    w0[FEATURES - 1, 0] = 1.0
    w, pull = w0.copy(), np.concatenate([np.full(FEATURES, 0.5), np.full(10, 20.0)])[:, None]
    rate = 1.0 / (m.sum() * 4 + pull.max())
    velocity = np.zeros_like(w)
    for _ in range(400):
        z = x @ (w + 0.9 * velocity)
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        grad = x.T @ (m[:, None] * (p - y)) + pull * (w - w0)
        velocity = 0.9 * velocity - rate * grad
        w = w + velocity
    even = lambda a: (a + a.T) / 2
    return Field(w[:FEATURES], even(w[FEATURES : FEATURES + 5]), even(w[FEATURES + 5 :]))


def added(texts: list[str], bases: list[list[tuple[int, int, int]]], field: Field, sure: float = SURE) -> list[list[tuple[int, int, int]]]:
    """The spans that the field adds to each text; all texts' graphs are worked on together."""
    feats, seen, chain, skip, owner = [], [], [], [], []
    for d, (text, spans) in enumerate(zip(texts, bases, strict=True)):
        if not HINT.search(text):
            continue
        found, c, s = nodes(text, spans)
        at = len(feats)
        feats += [f[2] for f in found]
        seen += [f[3] for f in found]
        owner += [(d, f[0], f[1]) for f in found]
        chain += [(i + at, j + at) for i, j in c]
        skip += [(i + at, j + at) for i, j in s]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not feats:
        return out
    pairs = lambda e: np.array(e, np.int64).reshape(-1, 2)
    p = field.marginals(np.array(feats), np.array(seen), pairs(chain), pairs(skip), np.array([o[0] for o in owner]))
    joined = {j: i for i, j in chain}
    kind_at: dict[int, int] = {}
    for i in np.flatnonzero((np.array(seen) == 0) & (p[:, 0] < 1 - sure)):
        k = int(p[i, 1:].argmax())
        d, a, b = owner[i]
        kind_at[i] = k
        before = joined.get(i)
        if before is not None and kind_at.get(before) == k and out[d]:
            out[d][-1] = (k, out[d][-1][1], b)
        else:
            out[d].append((k, a, b))
    return out


def find(docs: DataFrame, field: Field | None = None, keep_text: bool = False) -> DataFrame:
    """Add the arrays base_spans and spans (kind, start, end), by kind as listed, then start."""
    field = field or train(docs)
    own = ("base_spans", "spans")
    rest = [f for f in docs.schema.fields if f.name.lower() not in own and (keep_text or f.name != "text")]
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*rest, T.StructField("base_spans", span), T.StructField("spans", span)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            bases = [base_spans(t) for t in texts]
            more = added(texts, bases, field)
            named = lambda s: [{"kind": KINDS[k], "start": x, "end": y} for k, x, y in s]
            cols = [pa.array([named(s) for s in bases], arrow), pa.array([named(sorted(s + m)) for s, m in zip(bases, more, strict=True)], arrow)]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in rest], *cols], names=[f.name for f in schema.fields])

    return docs.select("text", *[f.name for f in rest if f.name != "text"]).mapInArrow(run, schema)


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The same rows and columns with each span of the text replaced by its kind in brackets; n_chars follows if there is one."""
    field = field or train(docs)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("text").to_pylist()
            texts = [t or "" for t in raw]
            bases = [base_spans(t) for t in texts]
            out = []
            for t, s, m, r in zip(texts, bases, added(texts, bases, field), raw, strict=True):
                parts, at = [], 0
                for k, x, y in sorted(s + m, key=lambda v: v[1:]):
                    if y > at:
                        parts += [t[at : max(at, x)], f"[{KINDS[k]}]" if x >= at else ""]
                        at = y
                out.append("".join([*parts, t[at:]]) if parts else r)
            cols = {"text": pa.array(out, b.column("text").type)}
            if "n_chars" in b.schema.names:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([cols.get(n, b.column(n)) for n in b.schema.names], names=b.schema.names)

    return docs.mapInArrow(run, schema)


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
