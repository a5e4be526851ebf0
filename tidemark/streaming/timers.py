"""Keyed state with event-time timers: events that close by silence and reopen, records that end when they are missed.

What lies behind a row in event time is settled before the row, so the outcome does not depend on how rows in order fall
into micro-batches; timers settle what no later row of the key settles, and drop what is out of reach.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .ledger_stream import PIECE, _in_order

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timed_state(spark: SparkSession):
    """Sets the state store that timers need, for queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded length."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == PIECE:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


class _Live:
    """The events of a cell by id: [last_us, lon, lat, open, final], by place, and by when something is due for them."""

    def __init__(self, events: dict[int, list], silence: int, margin: int, radius: float | None):
        self.silence, self.margin, self.radius = silence, margin, radius
        self.step = radius / 111320.0 * (1 + 1e-9) if radius else 0.0
        self.events: dict[int, list] = {}
        self.places: dict[tuple[int, int], set[int]] = {}
        self.due: list[tuple[int, int]] = []
        for event_id, e in events.items():
            self.put(event_id, e)

    def _column(self, x: float, band: int) -> int:
        far = max(abs(band), abs(band + 1)) * self.step
        return math.floor(x * math.cos(math.radians(far)) / self.step) if far < 89.9 else 0

    def _place(self, x: float, y: float) -> tuple[int, int]:
        if not self.step:
            return 0, 0
        band = math.floor(y / self.step)
        return band, self._column(x, band)

    def when(self, e: list) -> int:
        """The last instant at which an event stays as it is."""
        return e[0] + (self.silence if e[3] else self.margin)

    def put(self, event_id: int, e: list) -> None:
        self.events[event_id] = e
        self.places.setdefault(self._place(e[1], e[2]), set()).add(event_id)
        heapq.heappush(self.due, (self.when(e), event_id))

    def near(self, x: float, y: float) -> Iterator[tuple[float, int]]:
        """(distance, id) of the events within the radius; of all without one."""
        if not self.step:
            yield from ((0.0, event_id) for event_id in self.events)
            return
        band, across = math.floor(y / self.step), 111320.0 * math.cos(math.radians(y))
        for row in (band - 1, band, band + 1):
            column = self._column(x, row)
            for c in range(column - 2, column + 3):  # columns of a row next to it may be a little narrower
                for event_id in self.places.get((row, c), ()):
                    e = self.events[event_id]
                    d = math.hypot((x - e[1]) * across, (y - e[2]) * 111320.0)
                    if d <= self.radius:
                        yield d, event_id

    def settle(self, at: int) -> Iterator[tuple]:
        """Closes what has been silent by ``at`` and drops what is out of reach."""
        while self.due and self.due[0][0] < at:
            when, event_id = heapq.heappop(self.due)
            e = self.events.get(event_id)
            if e is None or self.when(e) != when:  # something came since
                continue
            if e[3]:
                e[3] = False
                heapq.heappush(self.due, (self.when(e), event_id))
                yield None, event_id, "closed", when
            else:
                place = self._place(e[1], e[2])
                self.places[place].discard(event_id)
                if not self.places[place]:
                    del self.places[place]
                del self.events[event_id]


#: Groups of cells that share a state row, so that a call of Python serves many cells; cells without a name are group -1.
GROUPS = 4096


class Resolver:
    """Observations of a cell join the nearest event in reach of time and place, or open one under their own id.

    * An event closes ``silence_us`` after its last report.  A later report in reach reopens it, unless the report before the
      silence closed it for good; then a new event opens.
    * An event is out of reach, and leaves the state, ``margin_us`` after its last report (no sooner than it closes).
    * Events are found by place, and by when they close or leave, so a report looks at those around it alone.
    * Cells share nothing but their group's state row and its timer, which is when the first event of the group is due: a call
      for each cell, event and timer would cost far more than the work, where cells are many.
    """

    STATE = "cell array<{}>, event_id array<long>, last_us array<long>, lon array<double>, lat array<double>, open array<boolean>, final array<boolean>"

    def __init__(self, cell: str, silence_us: int, margin_us: int, radius_m: float | None):
        self.cell, self.silence, self.margin, self.radius = cell, silence_us, max(silence_us, margin_us), radius_m

    def _load(self, group: int, state: GroupState) -> dict:
        cells: dict = {}
        for name, event_id, *e in zip(*state.get) if state.exists else ():
            self._live(cells, group, name)[1].put(event_id, e)
        return cells

    def _live(self, cells: dict, group: int, name) -> tuple:
        name = None if group < 0 else math.nan if name != name else name
        if name not in cells:
            cells[name] = _Live({}, self.silence, self.margin, self.radius)
        return name, cells[name]

    def _step(self, live: _Live, at: int, observation: int, x: float, y: float, final: bool) -> Iterator[tuple]:
        yield from live.settle(at)
        reach = [(d, -live.events[e][0], e) for d, e in live.near(x, y) if abs(at - live.events[e][0]) <= self.margin]
        usable = [r for r in reach if live.events[r[2]][3] or not live.events[r[2]][4]]
        if usable:
            event_id = min(usable)[2]
            e = live.events[event_id]
            outcome = "linked" if e[3] else "reopened"
            live.put(event_id, [max(e[0], at), e[1], e[2], True, bool(final) if at >= e[0] else e[4]])
        else:
            event_id, outcome = observation, "new" if reach else "opened"
            live.put(event_id, [at, float(x), float(y), True, bool(final)])
        yield observation, event_id, outcome, at

    def _store(self, state: GroupState, cells: dict) -> None:
        held = [(name, event_id, *e) for name, live in cells.items() for event_id, e in live.events.items()]
        if not held:
            state.remove()
            return
        state.update(tuple(map(list, zip(*held))))
        state.setTimeoutTimestamp(max(1, min(live.when(e) for live in cells.values() for e in live.events.values()) // 1000))

    def outcomes(self, group: int, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[tuple]:
        """(cell, observation_id, event_id, outcome, us) of a group's rows, if it has any, and of what is due by the watermark."""
        cells = self._load(group, state)
        if not state.hasTimedOut:
            order = ["us", "observation_id"]
            for at, observation, x, y, final, name in _in_order(batches, order, [*order, "lon", "lat", "final", self.cell]):
                name, live = self._live(cells, group, name)
                for told in self._step(live, int(at), int(observation), x, y, final):
                    yield name, *told
        for name, live in cells.items():
            for told in live.settle(max(0, state.getCurrentWatermarkMs()) * 1000):
                yield name, *told
        self._store(state, cells)


def resolve(stream: DataFrame, cell: str, silence_us: int, margin_us: int, radius_m: float | None, delay: str) -> DataFrame:
    """(cell, observation_id, event_id, outcome, us) of a stream (cell, observation_id, us, lon, lat, final): what became of
    each observation (opened, new, linked, reopened), and a row for each closure, without an observation.

    ``final`` marks reports that close their event for good.  Rows later than ``delay`` are dropped by the watermark.  Cells
    are dealt into ``GROUPS`` state rows: choose cells so that a group's events within ``margin_us`` fit a task; rows of one
    micro-batch may spill.  A row without a time, an id or, with a radius, a place has no outcome."""
    kind = stream.schema[cell].dataType.simpleString()
    usable = F.col("us").isNotNull() & F.col("observation_id").isNotNull() & (F.lit(True) if radius_m is None else F.col("lon").isNotNull() & F.col("lat").isNotNull())
    group = F.when(F.col(cell).isNull(), -1).otherwise(F.pmod(F.xxhash64(cell), F.lit(GROUPS))).cast("int").alias("__group")
    rows = stream.where(usable).select(group, cell, "observation_id", "us", F.coalesce("lon", F.lit(0.0)).alias("lon"), F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("final", F.lit(False)).alias("final"), F.timestamp_micros("us").alias("at"))
    resolver = Resolver(cell, silence_us, margin_us, radius_m)
    whole = "Int64" if kind in ("tinyint", "smallint", "int", "bigint") else object

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found = resolver.outcomes(int(key[0]), batches, state)
        while piece := list(itertools.islice(found, PIECE)):
            names, observations, events, outcomes, times = zip(*piece)  # ids stay whole numbers beside those that are missing
            yield pd.DataFrame({cell: pd.array(names, dtype=whole), "observation_id": pd.array(observations, dtype="Int64"), "event_id": events, "outcome": outcomes, "us": times})

    return rows.withWatermark("at", delay).groupBy("__group").applyInPandasWithState(
        step, f"{cell} {kind}, observation_id long, event_id long, outcome string, us long", Resolver.STATE.format(kind), "append", GroupStateTimeout.EventTimeTimeout
    )


class Presence(StatefulProcessor):
    """One record of a feed: its versions by fingerprint, its end after it was missed, its return."""

    COLUMNS = ["change", "version", "us"]

    def __init__(self, missed_us: int, forget_us: int):
        self.missed, self.forget = missed_us, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "last_us long, fingerprint string, version long, here boolean")

    def _steps(self, state: list, rows: Iterator[tuple]) -> Iterator[tuple]:
        for at, fingerprint in rows:
            at = int(at)
            last, old, version, here = state
            if last is None:
                state[:] = [at, fingerprint, 1, True]
                yield "created", 1, at
                continue
            if here and at - last > self.missed:
                here = False
                yield "ended", version, last + self.missed
            changed = fingerprint != old
            version += changed
            if not here:
                yield "returned", version, at
            elif changed:
                yield "revised", version, at
            state[:] = [max(last, at), fingerprint, version, True]

    def _store(self, state: list) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.record.update(tuple(state))
        self.handle.registerTimer((state[0] + (self.missed if state[3] else self.forget)) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.record.get()) if self.record.exists() else [None, None, 0, False]
        yield from _frames(self._steps(state, _in_order(rows, ["us", "fingerprint"], ["us", "fingerprint"])), self.COLUMNS)
        if state[0] is not None:
            self._store(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.record.exists():
            return
        state, now = list(self.record.get()), timerValues.getCurrentWatermarkInMs() * 1000
        if state[3] and now - state[0] > self.missed:
            state[3] = False
            yield pd.DataFrame([("ended", state[2], state[0] + self.missed)], columns=self.COLUMNS)
        if now - state[0] > self.forget:
            self.record.clear()
        else:
            self._store(state)

    def close(self) -> None:
        pass


def presence(stream: DataFrame, keys: list[str], missed_us: int, forget_us: int, delay: str) -> DataFrame:
    """(keys, change, version, us) of a stream of polled records (keys, us, fingerprint): created, revised, ended, returned.

    A record ends once no poll has shown it for ``missed_us`` (as many polls as a feed's threshold says), by timer if nothing
    follows; one that returns goes on with its versions.  ``forget_us`` after its last sight (at least ``missed_us``) an ended
    record leaves the state and would be created anew.  A record is a key, so no feed is gathered in one task."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    class Keyed(Presence):
        """The record's rows with its keys."""

        def _keyed(self, key, frames):
            for frame in frames:
                yield frame.assign(**dict(zip(keys, key)))[[*keys, *self.COLUMNS]]

        def handleInputRows(self, key, rows, timerValues):
            return self._keyed(key, super().handleInputRows(key, rows, timerValues))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            return self._keyed(key, super().handleExpiredTimer(key, timerValues, expiredTimerInfo))

    rows = stream.where(F.col("us").isNotNull()).select(*keys, "us", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), F.timestamp_micros("us").alias("at"))
    return rows.withWatermark("at", delay).groupBy(*keys).transformWithStateInPandas(
        Keyed(missed_us, max(missed_us, forget_us)), ", ".join([*(f"{k} {kinds[k]}" for k in keys), "change string, version long, us long"]), "Append", "EventTime"
    )
