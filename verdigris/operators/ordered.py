"""Ordered passes over each key's rows that hold one state, not the rows.

A state machine reads a key's events in order. Rows are sorted into ranges of (key,
order), so one key may lie over many tasks; each task sees which states its first key
could be entered with and where each would lead, those maps are composed along the
tasks (a few entries a task), and a second pass runs each task from its true state.
Time is linear in the events, and a hot key is as many tasks as it has rows for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from verdigris.operators.shared import cut


@dataclass(frozen=True)
class Machine:
    """init: a key's first state. step(state, event) gives the next state and a reason code if the event is refused.

    touched(event): the states that the event may change, and all that it may lead to;
    any other stays as it is. Without it, states can't be listed and a key is one task.
    """

    init: object
    step: Callable[[object, tuple], tuple[object, str | None]]
    touched: Callable[[tuple], Iterable[str]] | None = None


class Paths:
    """Where each state that a run of events may be entered with has led so far."""

    def __init__(self, machine: Machine):
        self.machine, self.at, self.seen = machine, {}, set()

    def take(self, event: tuple) -> None:
        states = set(self.machine.touched(event))
        for s in states - self.seen:
            self.at.setdefault(s, []).append(s)
        self.seen |= states
        moved: dict[str, list] = {}
        for s in states:
            starts = self.at.pop(s, None)
            if starts:
                to = self.machine.step(s, event)[0]
                have = moved.get(to)
                if have is None:
                    moved[to] = starts
                else:  # the shorter list goes into the longer one
                    moved[to] = have + starts if len(have) >= len(starts) else starts + have
        self.at |= moved

    def ends(self) -> dict[str, str]:
        return {start: s for s, starts in self.at.items() for start in starts}


def rows_of(batches: Iterable[pa.RecordBatch], key: str, cols: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(b.column(key).to_pylist(), zip(*(b.column(c).to_pylist() for c in cols), strict=True), strict=True)


def scan(events: DataFrame, key: str, order: list[str], cols: list[str], machine: Machine, state: str = "string") -> DataFrame:
    """key, the order columns, the state after each event and the reason code of refused ones.

    Null keys are one key. Events that tie in the order are taken by their other columns.
    """
    given = [*order, *[c for c in cols if c not in order]]
    d = events.select(key, *given)
    by = [key, *order, *[c for c in given if c not in order]]
    if machine.touched is None:
        return _run(d.repartition(key).sortWithinPartitions(*by), key, order, cols, machine, state, {})
    p = cut(d.repartitionByRange(*by).sortWithinPartitions(*by))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first key's paths, and the last key's state if it begins here."""
        first = last = now = None
        paths, count = Paths(machine), 0
        for k, event in rows_of(batches, key, cols):
            if count == 0:
                first = last = k
                count = 1
            elif k != last:
                last, now, count = k, machine.init, count + 1
            if count == 1:
                paths.take(event)
            else:
                to, reason = machine.step(now, event)
                now = now if reason else to
        if count:
            ends = paths.ends()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": pa.array([first], kind), "last": pa.array([last], kind), "one": [count == 1], "starts": pa.array([list(ends)], pa.list_(pa.string())), "ends": pa.array([list(ends.values())], pa.list_(pa.string())), "now": pa.array([now], pa.string())})

    kind = to_arrow_schema(T.StructType([d.schema[key]])).field(0).type
    shape = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", d.schema[key].dataType), T.StructField("last", d.schema[key].dataType), T.StructField("one", T.BooleanType()), T.StructField("starts", T.ArrayType(T.StringType())), T.StructField("ends", T.ArrayType(T.StringType())), T.StructField("now", T.StringType())])
    entry: dict[int, object] = {}
    before = None
    # One row a partition, whose map has an entry a state (of the finite ones, or of the actors in that run).
    for r in sorted(p.mapInArrow(summary, shape).collect(), key=lambda r: r["part"]):
        start = before[1] if before is not None and before[0] == r["first"] else machine.init
        entry[r["part"]] = start
        before = (r["last"], dict(zip(r["starts"], r["ends"], strict=True)).get(start, start) if r["one"] else r["now"])
    return _run(p, key, order, cols, machine, state, entry)


def _run(p: DataFrame, key: str, order: list[str], cols: list[str], machine: Machine, state: str, entry: dict[int, object]) -> DataFrame:
    schema = T.StructType([p.schema[c] for c in (key, *order)])
    held = T._parse_datatype_string(f"state {state}, reason_code string")
    types = [f.type for f in to_arrow_schema(held)]
    names = [*schema.names, *held.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        last, now, started = None, None, False
        for b in batches:
            states, reasons = [], []
            for k, event in rows_of([b], key, cols):
                if not started or k != last:
                    now = machine.init if started else entry.get(at, machine.init)
                    last, started = k, True
                to, reason = machine.step(now, event)
                now = now if reason else to
                states.append(now)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (key, *order)), pa.array(states, types[0]), pa.array(reasons, types[1])], names=names)

    return p.mapInArrow(run, T.StructType([*schema.fields, *held.fields]))
