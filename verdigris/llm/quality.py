"""Quality rules with risk-controlled cutoffs, all in DataFrame expressions.

Every document gets the figures of the usual rules. Fixed rules (`base_failed`)
come first; for the others (symbols a word, shares of repeated words, of repeated
lines and of capitals) cutoffs are chosen together on labelled documents.

A choice names a cutoff of a fixed ladder, or none, for each rule. For every
stratum and every choice an exact binomial test asks whether the rate of good
documents that any of its rules rejects is at most `risk`. Each test is made at
`error` / (number of strata * number of choices). So with probability 1 - error no
choice that passes rejects more than `risk` of a stratum's good documents (those
that the fixed rules let through), whichever of them is taken. Of those that
pass, the one that rejects most of the labelled bad documents is taken; at ties
the one that rejects fewest good ones, then the one with the highest cutoffs. A
stratum without enough labels keeps everything.

All labelled documents are counted, each doc_id once. Strata are the `STRATA`
languages with most labels (ties by name) and one for all others. What reaches
the driver is one row per stratum, label and steps exceeded: 25 * 2 * 1764 rows
at most.

Nulls: a null text has no words (base_failed); a null language is among the
others; null labels don't count; a doc_id labelled more than once counts once, as
good if any label says so. Very long texts are measured whole, in time near their
length times its logarithm. Extra columns are kept, whatever their names; those
named like the result's columns are replaced. Repeated rows get equal results;
empty tables give empty ones.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import SPACE, cut, let, words, written

WINDOW, STRATA = 8, 24
OTHER = "other languages"
#: Symbols a word and shares of words or lines above which a rule may reject; strictest first.
LADDER = {"symbols": (0.1, 0.2, 0.3, 0.5, 0.7, 1.0), "repeats": (0.05, 0.1, 0.15, 0.2, 0.25), "lines": (0.2, 0.3, 0.4, 0.5, 0.6, 0.8), "capitals": (0.3, 0.4, 0.5, 0.6, 0.8)}
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "base_failed")
OWN = (*FIGURES, "kept")
#: Cutoffs of each stratum by rule; rules without one are missing.
Cutoffs = dict[str, dict[str, float]]


def repeat_words(hashes: Column) -> Column:
    """How many words stand in windows that occur at least twice; `hashes`: of the windows, by place.

    Windows are sorted by (hash, place); those next to an equal hash are repeated.
    Each covers WINDOW words or as many as stand before the next one.
    """
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(p: Column) -> Column:
        none = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(0).alias("i"))
        follow = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), F.coalesce(b["h"] == a["h"], F.lit(False)).alias("hit")))
        before = F.concat(F.array(none), F.slice(p, F.lit(1), F.size(p) - 1))
        either = F.zip_with(follow, before, lambda a, b: F.when(a["hit"] | F.coalesce(b["h"] == a["h"], F.lit(False)), a["i"]))
        return F.sort_array(F.filter(either, lambda i: i.isNotNull()))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at"))
    return F.aggregate(let(pairs, places), start, lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["at"])).cast("long").alias("n"), p.alias("at")), lambda s: s["n"])


def measured(rows: DataFrame) -> DataFrame:
    """`rows` (row, text; no null texts) to row and the figures; n_lines: lines with a word, n_caps: words in capitals."""
    text = F.col("text")
    d = rows.select("row", "text", words(text).alias("words"))
    lines = F.when(F.contains(text, F.lit("\n")), F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))).otherwise(F.array().cast("array<string>"))
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    places = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    windows = let(hashes, lambda h: F.transform(places, lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    d = d.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])\p{Lu}{2,}+[^\p{Ll}\x20\x09-\x0D]*+(?![^\x20\x09-\x0D])")).cast("long").alias("n_caps"),
        lines.alias("lines"),
        F.when(F.size("words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    repeated = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), repeat_words(F.col("windows"))).otherwise(F.lit(0))
    d = d.select(
        "row", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.greatest(F.size("lines"), F.lit(1)).cast("long").alias("n_lines"),
        "n_caps",
    )
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))


def _packed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The caller's columns as one, so that their names can't clash with ours, and the text."""
    return docs.select(F.struct(*columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"))


def figures(docs: DataFrame) -> DataFrame:
    """Add the figures to `docs`."""
    kept = [c for c in docs.columns if c.lower() not in OWN]
    return measured(_packed(docs, kept)).select("row.*", *FIGURES)


def _scores() -> dict[str, Column]:
    n = F.greatest("n_words", F.lit(1))
    return {"symbols": F.col("n_symbols") / n, "repeats": F.col("n_repeat_words") / n, "lines": F.col("n_dup_lines") / F.col("n_lines"), "capitals": F.col("n_caps") / n}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed downwards from k; never below the true value by more than rounding."""
    if k >= n:
        return 1.0
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total = term = 1.0
    for j in range(k, 0, -1):
        term *= j / (n - j + 1) * (1 - p) / p
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, math.exp(top) * total)


def choose(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> tuple[int, ...] | None:
    """The choice of a stratum, a place in each rule's ladder (its length: no cutoff).

    `good` and `bad` count documents by the number of steps they exceed in each
    rule. A document stays if it exceeds at most as many steps as the choice's
    places say, so sums over the lower corner give what every choice keeps.
    """
    n = int(good.sum())
    most = -1  # the most rejections with which a test still shows the rate to be at most `risk`
    while most < n and binomial_tail(most + 1, n, risk) <= level:
        most += 1
    stays = [good.astype(np.int64), bad.astype(np.int64)]
    for axis in range(good.ndim):
        stays = [x.cumsum(axis) for x in stays]
    lost, gain = n - stays[0], int(bad.sum()) - stays[1]
    passed = np.argwhere(lost <= most)
    return max(map(tuple, passed.tolist()), key=lambda c: (gain[c], -lost[c], sum(c), c), default=None)


def cutoffs(scored: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05, strata: int = STRATA) -> Cutoffs:
    """The chosen cutoffs. `scored`: doc_id, lang and the figures.

    The labels are aggregated to one row a document before the join, and so are
    rows that repeat a doc_id.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("quality") >= 1).alias("good"))
    score = _scores()
    steps = [sum(((score[r] > c).cast("int") for c in LADDER[r]), F.lit(0)).alias(r) for r in LADDER]
    held = scored.filter(~F.col("base_failed")).select("doc_id", "lang", *steps).groupBy("doc_id").agg(F.min(F.struct("lang", *LADDER)).alias("d")).join(known, "doc_id")
    counts = cut(held.groupBy("d.lang", "good", *[F.col(f"d.{r}").alias(r) for r in LADDER]).agg(F.count(F.lit(1)).alias("n")))
    named = [r["lang"] for r in counts.filter("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(strata).collect()]
    stratum = F.when(F.col("lang").isin(named), F.col("lang")).otherwise(OTHER) if named else F.lit(OTHER)
    rows = counts.groupBy(stratum.alias("stratum"), "good", *LADDER).agg(F.sum("n").alias("n")).collect()
    shape = tuple(len(x) + 1 for x in LADDER.values())
    level = error / ((len(named) + 1) * math.prod(shape))
    tables: dict[str, list[np.ndarray]] = {s: [np.zeros(shape, np.int64) for _ in range(2)] for s in [*named, OTHER]}
    for r in rows:
        tables[r["stratum"]][int(r["good"])][tuple(r[x] for x in LADDER)] += r["n"]
    out: Cutoffs = {}
    for s, (bad, good) in tables.items():
        found = choose(good, bad, risk, level)
        out[s] = {r: LADDER[r][i] for r, i in zip(LADDER, found, strict=True) if i < len(LADDER[r])} if found else {}
    return out


def judge(figured: DataFrame, chosen: Cutoffs) -> DataFrame:
    """Add kept: no fixed rule failed and no figure over its stratum's cutoff."""
    score = _scores()
    over = lambda s: F.lit(False) if not chosen.get(s) else F.array_contains(F.array(*[score[r] > c for r, c in sorted(chosen[s].items())]), True)
    reject = over(OTHER)
    for s in sorted(set(chosen) - {OTHER}):
        reject = F.when(F.col("lang") == s, over(s)).otherwise(reject)
    return figured.withColumn("kept", ~F.col("base_failed") & ~reject)


def quality(docs: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """Figures and verdict of every document, without its text.

    The figures are computed once and checkpointed (some numbers a document);
    the cutoffs and the verdicts both come from them.
    """
    slim = cut(figures(docs).drop("text"))
    return judge(slim, cutoffs(slim, labels, risk, error))


def kept_documents(docs: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """The documents that the rules keep, with the columns of `docs`.

    The figures are computed once: rows and figures are written as a table, whose
    figures alone are read for the cutoffs. Texts are not shuffled.
    """
    full = written(measured(_packed(docs, docs.columns)), "quality").withColumn("doc_id", F.col("row.doc_id")).withColumn("lang", F.col("row.lang"))
    chosen = cutoffs(full.select("doc_id", "lang", *FIGURES), labels, risk, error)
    return judge(full, chosen).filter("kept").select("row.*")
