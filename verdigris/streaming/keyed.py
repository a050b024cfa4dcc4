"""Keyed streaming state with event-time timers, for `transformWithStateInPandas`.

Files may be read in any order: rows wait in a buffer of their key until the watermark
has passed them, are then folded in time order, and the state of a key leaves once no
row that may still come can change it. A row behind the watermark is dropped by Spark,
so a replay that comes after its key's state has left has no second effect.

A call between Python and the state store costs milliseconds, and so does a timer. So keys
are dealt over BUCKETS buckets by their hash: a bucket has one timer, its keys' state lies
in a few texts of up to CHUNK entries, is read and written as a whole, and a step costs
calls by bucket and not by key. A bucket's rows are held by one task at a time.

Rows have the columns of `ROW`: `key` (the key's columns as JSON), `at` (event time, with the watermark), `ord` (order
among equal times), `body` (their content as JSON) and `ends`. A row with `ends` true
carries only a time and moves the watermark; see `jobs.drained`.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROW = ("key", "at", "ord", "body", "ends")
BUCKETS = 1024
CHUNK = 20_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rows(stream: DataFrame, keys: dict, at: str, order, body: list) -> DataFrame:
    """A stream's rows in the form that the processors take; keys: name to column."""
    key = F.to_json(F.struct(*[c.alias(k) for k, c in keys.items()]))
    return stream.select(key.alias("key"), F.col(at).alias("at"), order.cast("long").alias("ord"), F.to_json(F.struct(*body) if body else F.struct(F.lit(1).alias("x"))).alias("body"), F.coalesce("ends", F.lit(False)).alias("ends"))


def batch_rows(frames: Iterator[pd.DataFrame]) -> list[tuple]:
    """(key, us, ord, body) of a batch's rows, without end marks."""
    out: list[tuple] = []
    for f in frames:
        f = f[~f["ends"].astype(bool)]
        if len(f):
            us = (f["at"].astype("datetime64[us]")).astype("int64")
            out += zip(f["key"], us.tolist(), f["ord"].astype("int64").tolist(), f["body"], strict=True)
    return out


class Entries:
    """A list of JSON values of a bucket, kept as texts of up to CHUNK values."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.texts = handle.getListState(name, "entries string")

    def get(self) -> list:
        return [e for t in (self.texts.get() if self.texts.exists() else ()) for e in json.loads(t[0])]

    def _cut(self, entries: list) -> list[tuple]:
        return [(json.dumps(entries[k : k + CHUNK]),) for k in range(0, len(entries), CHUNK)]

    def add(self, entries: list) -> None:
        self.texts.appendList(self._cut(entries))

    def put(self, entries: list) -> None:
        if entries:
            self.texts.put(self._cut(entries))
        else:
            self.texts.clear()


class Processor(StatefulProcessor):
    """What all have in common: a timer is in milliseconds and rings when the watermark has reached it.

    Timers of one bucket that the watermark passes at once are one.
    """

    keys: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rung = handle, {}

    def ring(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def frame(self, found: list[tuple]) -> Iterator[pd.DataFrame]:
        """found: (key, *columns)"""
        if found:
            named = [(json.loads(k), f) for k, *f in found]
            yield pd.DataFrame([(*(k.get(c) for c in self.keys), *f) for k, f in named], columns=self.columns, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        if self.rung.get(key) != mark:
            self.rung[key] = mark
            yield from self.frame(self.expired(mark))

    def expired(self, mark: int) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Ordered(Processor):
    """Folds each key's rows in order of (at, ord), as far as the watermark has come.

    fold(state or None, rows) gives the new state and the rows to emit; rows are
    (us, ord, content), a state is a tuple of JSON values. until(state) is the time in
    microseconds after which the state can be forgotten if no row waits, None if it has
    to stay.
    """

    def __init__(self, columns: list[str], fold: Callable, until: Callable):
        self.columns, self.fold, self.until = columns, fold, until

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held, self.state = Entries(handle, "held"), Entries(handle, "state")

    def handleInputRows(self, key, frames, timerValues):
        new = batch_rows(frames)
        if new:
            self.held.add(new)
            self.ring(min(r[1] for r in new))
        yield from ()

    def expired(self, mark: int) -> list[tuple]:
        held = self.held.get()
        due, wait = sorted(r for r in held if r[1] <= mark), [r for r in held if r[1] > mark]
        states = {k: tuple(s) for k, s in self.state.get()}
        out: list[tuple] = []
        for k, group in itertools.groupby(due, key=lambda r: r[0]):
            states[k], found = self.fold(states.get(k), [(t, o, json.loads(b)) for _, t, o, b in group])
            out += [(k, *f) for f in found]
        waiting = {r[0] for r in wait}
        ends = {k: self.until(s) for k, s in states.items() if k not in waiting}
        kept = {k: s for k, s in states.items() if ends.get(k) is None or ends[k] > mark}
        if due:
            self.held.put(wait)
        if due or len(kept) < len(states):
            self.state.put(list(kept.items()))
        later = [r[1] for r in wait] + [end for end in ends.values() if end is not None and end > mark]
        if later:
            self.ring(min(later))
        return out


class Deciding(Processor):
    """The first known outcome of a key at once; the same again is a replay, any other is refused (neither is emitted), unknown ones are errors.

    The outcome leaves when the watermark has passed the last row that came with it.
    """

    columns = ["id", "outcome", "status"]

    def __init__(self, known: tuple[str, ...]):
        self.known = known

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = Entries(handle, "decided")

    def handleInputRows(self, key, frames, timerValues):
        new = sorted(((o, t, k, json.loads(b).get("outcome")) for k, t, o, b in batch_rows(frames)), key=lambda r: r[:2])
        out = [(k, outcome, "error") for _, _, k, outcome in new if outcome not in self.known]
        good = [(k, outcome, t) for _, t, k, outcome in new if outcome in self.known]
        if good:
            decided = {k: (outcome, last) for k, outcome, last in self.state.get()}
            for k, outcome, t in good:
                had = decided.get(k)
                if had is None:
                    out.append((k, outcome, "decided"))
                decided[k] = (had[0], max(had[1], t)) if had else (outcome, t)
            self.state.put([(k, *d) for k, d in decided.items()])
            self.ring(min(t for _, t in decided.values()))
        yield from self.frame(out)

    def expired(self, mark: int) -> list[tuple]:
        decided = [d for d in self.state.get() if d[2] > mark]
        self.state.put(decided)
        if decided:
            self.ring(min(d[2] for d in decided))
        return []


class Terminal(Processor):
    """A key once, when all its fields have come, none of them bad; a field that comes twice counts once.

    State: the fields by id, until the key is done, and a mark (done, last row's time) a key. Both leave when the
    watermark is `keep` past the key's last row, done or not.
    """

    columns = ["page_id"]

    def __init__(self, keep_us: int):
        self.keep = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.fields, self.page = Entries(handle, "fields"), Entries(handle, "page")

    def handleInputRows(self, key, frames, timerValues):
        new = batch_rows(frames)
        if not new:
            return
        fields, pages, want = dict(self.fields.get()), {k: (done, last) for k, done, last in self.page.get()}, {}
        for k, t, _, b in new:
            done, last = pages.get(k, (False, t))
            pages[k] = (done, max(last, t))
            if not done:
                r = json.loads(b)
                fields.setdefault(k, {})[r.get("field", "")] = bool(r["ok"])
                want[k] = r["fields"]
        found = [k for k, n in want.items() if len(fields[k]) >= n and all(fields[k].values())]
        for k in found:
            del fields[k]
            pages[k] = (True, pages[k][1])
        self.fields.put(list(fields.items()))
        self.page.put([(k, *p) for k, p in pages.items()])
        self.ring(min(last for _, last in pages.values()) + self.keep)
        yield from self.frame([(k,) for k in found])

    def expired(self, mark: int) -> list[tuple]:
        pages = [p for p in self.page.get() if p[2] + self.keep > mark]
        stay = {p[0] for p in pages}
        self.fields.put([f for f in self.fields.get() if f[0] in stay])
        self.page.put(pages)
        if pages:
            self.ring(min(p[2] for p in pages) + self.keep)
        return []


def run(stream: DataFrame, keys: list[str], processor: Processor, schema: str | StructType, late: str) -> DataFrame:
    """The processor over a stream in the form of `rows`; `late`: how far behind the newest row others may come."""
    processor.keys = keys
    dealt = stream.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    return dealt.withWatermark("at", late).groupBy("bucket").transformWithStateInPandas(processor, schema, "append", "eventTime")
