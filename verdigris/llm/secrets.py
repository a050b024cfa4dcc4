"""Secret scans by character Markov models, all in DataFrame expressions.

Base rules (assignments, access keys, hex strings) give spans by regular
expressions. Runs of key characters that no base rule covers are scored by two
first-order Markov models, one of random strings and one of ordinary identifiers:
the sum over neighbouring characters of the log ratio of both models' transition
probabilities. Runs that reach the threshold are added as kind `markov`.

Training. The labelled samples are the values of base matches (random) and all
other runs (ordinary) of at most `SAMPLE` documents, those with the lowest hashes
of doc_id. Three quarters of these documents fit the models: transitions are
counted in Spark, and the table that reaches the driver has at most 2 * 68 * 68
rows. On the last quarter the threshold is chosen: at least the log odds that a run
is ordinary, and as low as leaves at most `FALSE_RATE` of the ordinary runs there
over it. The model carries its recall and false rate on that quarter. Counts are
smoothed, so the scan also works where a sample has no secret at all.

Offsets are code points, ends exclusive. Nulls: a null text counts as empty. Very
long texts are scanned whole, in time near their length. Scores at the threshold
are spans. Repeated rows get equal results; an empty table gives an empty one.
Extra columns are kept, whatever their names; those named like the result's
columns are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import let

#: Fixed patterns; a run is maximal, so the minimal lengths stand in the pattern where nothing else follows from a failing match.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: What the models are fitted on and what they look at. A run starts where no other is going on, which the look-behind says at once.
WORD, RUN, RUN_LEAST = r"[A-Za-z0-9+/_=-]{2,}", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+", 12
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"
SAMPLE, FALSE_RATE, CHUNK = 4000, 1e-4, 256
OWN = ("n_assign", "n_access", "n_hex", "spans", "base_spans")
SPAN = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"


@dataclass
class Model:
    """Log ratios of the transition probabilities, row by row of the alphabet; the threshold and what it did held out."""

    ratio: list[float]
    threshold: float
    recall: float = math.nan
    false_rate: float = math.nan


def running(values: Column, step=lambda a, b: a + b, first: int = 0) -> Column:
    """What `step` makes of all values before each place, in two levels so that long arrays don't cost their square."""
    sums = lambda a, start: F.aggregate(a, F.struct(start.cast("long").alias("s"), F.array().cast("array<bigint>").alias("o")), lambda t, x: F.struct(step(t["s"], x).cast("long").alias("s"), F.concat(t["o"], F.array(t["s"])).alias("o")), lambda t: t["o"])
    total = lambda a: F.aggregate(a, F.lit(first).cast("long"), lambda s, x: step(s, x).cast("long"))
    chunks = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(CHUNK)), lambda k: F.slice(values, k, CHUNK))
    return F.when(F.size(values) > 0, let(chunks, lambda c: F.flatten(F.zip_with(c, sums(F.transform(c, total), F.lit(first)), sums)))).otherwise(F.array().cast("array<bigint>"))


def spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Matches as (start, end, kind, value): the text between matches gives their places. Each part is worked out once."""

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return let(F.zip_with(between, found, lambda g, x: F.struct(F.length(g).cast("long").alias("gap"), F.length(x).cast("long").alias("size"))), lambda s: finished(s, found))

    def finished(steps: Column, found: Column) -> Column:
        before = let(F.transform(steps, lambda s: s["gap"] + s["size"]), lambda v: running(v))
        at = F.zip_with(before, steps, lambda b, s: F.struct((b + s["gap"]).alias("start"), (b + s["gap"] + s["size"]).alias("end")))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        return F.zip_with(at, value, lambda a, v: F.struct(a["start"].alias("start"), a["end"].alias("end"), F.lit(kind).alias("kind"), v.alias("value")))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(F.array().cast(SPAN))


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the arrays assign, access and hex to a frame that has none of these columns; `text` has no nulls."""
    assign = F.filter(spans(F.col(text), ASSIGN, 0, 2), lambda x: F.length(x["value"]) >= ASSIGN_LEAST)
    return docs.select("*", assign.alias("assign"), spans(F.col(text), ACCESS, 1).alias("access"), spans(F.col(text), HEX, 2).alias("hex"))


def labelled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """random (1 or 0), word, fit (false: held out), n: the labelled runs of the sample."""
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id"))
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    held = base(held.withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) > 0))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    samples = F.concat(
        F.transform(F.concat("assign", "access", "hex"), lambda x: F.struct(F.lit(1).alias("random"), x["value"].alias("word"))),
        F.transform(F.regexp_extract_all(bare, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.lit(0).alias("random"), w.alias("word"))),
    )
    return held.select("fit", F.explode(samples).alias("s")).groupBy("fit", "s.random", "s.word").agg(F.count(F.lit(1)).alias("n"))


def fitted(words: DataFrame) -> list[float]:
    """Log ratios from labelled words (random, word, n); a random string counts once however often it occurs."""
    steps = words.withColumn("n", F.when(F.col("random") == 1, 1).otherwise(F.col("n"))).withColumn("i", F.explode(F.expr("sequence(1, length(word) - 1)")))
    counts = steps.groupBy("random", F.substring("word", F.col("i"), F.lit(2)).alias("step")).agg(F.sum("n").alias("n")).collect()
    size = len(ALPHABET)
    table = [[[0.5] * size for _ in range(size)] for _ in range(2)]
    for r in counts:
        if len(r["step"]) == 2 and all(c in ALPHABET for c in r["step"]):
            table[r["random"]][ALPHABET.index(r["step"][0])][ALPHABET.index(r["step"][1])] += r["n"]
    logs = [[[math.log(x / sum(row)) for x in row] for row in t] for t in table]
    return [logs[1][a][b] - logs[0][a][b] for a in range(size) for b in range(size)]


def train(docs: DataFrame, sample: int = SAMPLE, false_rate: float = FALSE_RATE) -> Model:
    """Fit on three quarters of the sample, choose the threshold on the rest."""
    words = labelled(docs, sample)
    ratio = fitted(words.filter("fit"))
    held = words.filter("NOT fit").filter(F.length("word") >= RUN_LEAST)
    score = F.least(F.greatest(F.floor(llr(F.col("word"), ratio)), F.lit(-1000)), F.lit(1000)).cast("int")
    rows = held.groupBy("random", score.alias("score")).agg(F.sum("n").alias("n")).collect()
    total = [sum(r["n"] for r in rows if r["random"] == k) for k in (0, 1)]
    over = lambda k, t: sum(r["n"] for r in rows if r["random"] == k and r["score"] >= t)
    least = math.log((total[0] + 1) / (total[1] + 1))
    tried = sorted({math.ceil(max(0.0, least)), *(r["score"] + 1 for r in rows if r["score"] + 1 >= least)})
    t = next(t for t in tried if over(0, t) <= false_rate * total[0] or t == tried[-1])
    share = lambda k: over(k, t) / total[k] if total[k] else math.nan
    return Model(ratio, float(t), share(1), share(0))


def llr(word: Column, ratio: list[float]) -> Column:
    """Log-likelihood ratio of the two models for `word`, which has only characters of the alphabet."""
    table = F.expr(f"cast(split('{','.join(f'{x:.5f}' for x in ratio)}', ',') as array<double>)")
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    places = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), place)
    steps = let(places, lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.get(table, a * len(ALPHABET) + b)))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def uncovered(runs: Column, base_: Column) -> Column:
    """The runs that no base span touches: in order of starts, none before reaches into them and none after starts in them."""
    far = 1 << 62

    def apart(every: Column) -> Column:
        ends = let(F.transform(every, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), lambda v: running(v, F.greatest))
        starts = F.reverse(let(F.reverse(F.transform(every, lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(F.lit(far)))), lambda v: running(v, F.least, far)))
        near = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s")))
        marked = F.zip_with(every, near, lambda x, b: F.struct(x.alias("x"), b.alias("b")))
        return F.transform(F.filter(marked, lambda m: (m["x"]["kind"] == 3) & (m["b"]["e"] <= m["x"]["start"]) & (m["b"]["s"] >= m["x"]["end"])), lambda m: m["x"])

    by_start = F.array_sort(F.transform(F.concat(runs, base_), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["value"].alias("value"))))
    found = F.transform(let(by_start, apart), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value")))
    return F.when((F.size(runs) > 0) & (F.size(base_) > 0), found).otherwise(runs)


def scan(docs: DataFrame, model: Model | None = None, rules: bool = True) -> DataFrame:
    """Add n_assign, n_access, n_hex and the arrays base_spans and spans (start, end, kind as a name).

    Without `rules` only the models look for spans, also where a base rule would match.
    """
    model = model or train(docs)
    kept = [c for c in docs.columns if c.lower() not in OWN]
    d = docs.select(F.struct(*kept).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    d = base(d) if rules else d.select("*", *[F.array().cast(SPAN).alias(k) for k in KINDS[:3]])
    order = lambda a: F.array_sort(F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    d = d.select("row", *KINDS[:3], F.concat(*KINDS[:3]).alias("base"), spans(F.col("text"), RUN, 3).alias("runs"))
    d = d.withColumn("runs", F.when(F.size("runs") > 0, F.filter("runs", lambda x: llr(x["value"], model.ratio) >= model.threshold)).otherwise(F.col("runs")))
    d = d.withColumn("more", uncovered(F.col("runs"), F.col("base")))
    d = d.withColumn("all", order(F.concat("base", "more"))).withColumn("base", order(F.col("base")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    named = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1).alias("kind")))
    return d.select("row.*", *counts, named("base").alias("base_spans"), named("all").alias("spans"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
