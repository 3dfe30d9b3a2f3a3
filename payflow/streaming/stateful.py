"""Stateful operators on event time: counts over sliding ranges per event, and sessions folded from
a document change stream. They run on ``transformWithState`` (RocksDB state in the checkpoint folder), so the
state of a key survives lost executors and is dropped by timers of its own.

Order. Rows of a micro-batch come in any order, so an event waits in its key's state until the
watermark has passed it; then no earlier one can come (a batch drops rows behind the watermark that the
batch before it worked with), and the key's events are taken in order of time. Results
therefore equal those of the batch jobs over the same events, whatever the order of arrival.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB (needed by ``transformWithState``)."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _named(names: list[str], *values) -> Row:
    return Row(**dict(zip(names, values)))


def _millis_after(micros: int) -> int:
    return -(-micros // 1000)


class _OneTimer(StatefulProcessor):
    """Keeps one timer a key, at the earliest time (micros) that it waits for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "t long")

    def _wake_at(self, t: int) -> None:
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or t < due:
            if due is not None:
                self.handle.deleteTimer(_millis_after(due))
            self.due.update((t,))
            self.handle.registerTimer(_millis_after(t))

    def close(self) -> None:
        pass


class _InOrder(_OneTimer):
    """Holds a key's events (time in micros -> number) until the watermark has passed them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pending = handle.getMapState("pending", "t long", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = Counter(r["_t"] for r in rows)
        for t, n in came.items():
            before = self.pending.getValue((t,))[0] if self.pending.containsKey((t,)) else 0
            self.pending.updateValue((t,), (before + n,))
        self._wake_at(min(came))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((k[0], v[0]) for k, v in self.pending.iterator())
        ready = [x for x in waiting if x[0] <= passed]
        for t, _ in ready:
            self.pending.removeKey((t,))
        self.due.clear()
        if len(ready) < len(waiting):
            self._wake_at(waiting[len(ready)][0])
        elif not ready:                       # nothing came since the key's last event: its look-back is over
            self.forget()
        else:
            self._wake_at(ready[-1][0] + self.keep)
        yield from self.take(key, ready)


class SlidingCounts(_InOrder):
    """For every time at which a key has events: the events in ``[t - look_back, t]``, for several look-backs.
    The state is the ring of times inside the longest look-back."""

    def __init__(self, names: list[str], look_backs: list[int]):
        self.names, self.look_backs, self.keep = names, look_backs, max(look_backs)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getValueState("ring", "t array<long>, n array<long>")

    def forget(self) -> None:
        self.ring.clear()

    def take(self, key, ready: list[tuple[int, int]]) -> Iterator[Row]:
        ring = list(zip(*self.ring.get())) if self.ring.exists() else []
        for t, n in ready:
            ring = [x for x in ring if x[0] >= t - self.keep] + [(t, n)]
            yield _named(self.names, *key, t, n, *[sum(m for s, m in ring if s >= t - look) for look in self.look_backs])
        if ready:
            self.ring.update(([t for t, _ in ring], [n for _, n in ring]))


class Bursts(_InOrder):
    """Each burst once: the first event with more than ``more_than`` events in ``[t - window, t]`` whose
    predecessor (if no older than the window) had not. The state is a ring of the last ``more_than + 1``
    events: enough to see whether the number is passed, and to give it exactly where a burst starts."""

    def __init__(self, names: list[str], window: int, more_than: int):
        self.names, self.keep, self.more_than = names, window, more_than

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getValueState("ring", "t array<long>, n array<long>, above boolean")

    def forget(self) -> None:
        self.ring.clear()

    def take(self, key, ready: list[tuple[int, int]]) -> Iterator[Row]:
        times, counts, above = self.ring.get() if self.ring.exists() else ([], [], False)
        ring = list(zip(times, counts))
        for t, n in ready:
            above = above and bool(ring) and ring[-1][0] >= t - self.keep
            ring = [x for x in ring if x[0] >= t - self.keep] + [(t, n)]
            events = sum(m for _, m in ring)
            if events > self.more_than and not above:
                yield _named(self.names, *key, ring[0][0], t, events)
            above = events > self.more_than
            while len(ring) > 1 and sum(m for _, m in ring[1:]) > self.more_than:
                ring.pop(0)
        if ready:
            self.ring.update(([t for t, _ in ring], [n for _, n in ring], above))


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay).withColumn("_t", F.unix_micros(F.col(ts)))


def _seconds(s: int) -> int:
    return int(s) * 1_000_000


def sliding_counts(df: DataFrame, key: str, ts: str, look_backs: dict[str, int], delay: str = "1 hour") -> DataFrame:
    """K6: per key and event time the number of events there (``events``) and, for each name in ``look_backs``
    (seconds), in the closed range that ends there. ``ts`` is a timestamp column of the stream."""
    kind = df.schema[key].dataType.simpleString()
    names = "".join(f", {name} long" for name in look_backs)
    out = (_timed(df, ts, delay).select(key, ts, "_t").groupBy(key)
           .transformWithState(SlidingCounts([key, "_t", "events", *look_backs], [_seconds(s) for s in look_backs.values()]),
                               f"{key} {kind}, _t long, events long{names}", "Append", "EventTime"))
    return out.select(key, F.timestamp_micros("_t").alias(ts), "events", *look_backs)


def burst_stream(df: DataFrame, key: str, ts: str, window_s: int, more_than: int, delay: str = "10 minutes") -> DataFrame:
    """Each burst of more than ``more_than`` events of a key within ``window_s`` seconds, once,
    wherever it lies (no fixed window borders). Batch twin: ``operators.windows.burst_starts``."""
    kind = df.schema[key].dataType.simpleString()
    out = (_timed(df, ts, delay).select(key, ts, "_t").groupBy(key)
           .transformWithState(Bursts([key, "_from", "_t", "events"], _seconds(window_s), more_than),
                               f"{key} {kind}, _from long, _t long, events long", "Append", "EventTime"))
    return out.select(key, F.timestamp_micros("_from").alias("first_event"), F.timestamp_micros("_t").alias("detected_at"),
                      "events")


# ----------------------------------------------------------------------------- K13
SESSION_CHANGE = ("document_id string, customer_id long, device_type string, "
                  "event_id long, element string, completes boolean, at timestamp")
FOLDED = ("session_id string, customer_id long, device_type string, _s long, _e long, event_count long, "
          "pay_clicks long, converted boolean, duration_seconds long")


SESSION_GROUPS = 2048                  # state keys; what Python and its state calls cost a key is then shared by a group's sessions


class SessionFold(_OneTimer):
    """Session documents: their pushed events (of a replayed one the last counts), each document closed and
    given out by a timer once the watermark is ``gap`` past its last event. A state key is one document, or a
    group of those that the column ``by`` names. A batch adds one state row a document, all of a key in one call."""

    def __init__(self, gap: int, by: str | None = None):
        self.gap, self.by = gap, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.events = handle.getListState("events", "document string, customer_id long, device_type string, closes long, "
                                                    "id array<long>, t array<long>, pay array<boolean>, completes array<boolean>")

    def read(self, key, rows: Iterator[Row]) -> Iterator[tuple]:
        """(document, customer, device, event, time, pay, completes) per event; a heartbeat only moved the watermark."""
        return ((r[self.by] if self.by else key[0], r["customer_id"], r["device_type"], r["event_id"], r["_t"],
                 r["element"] == "pay_button", bool(r["completes"])) for r in rows if r["event_id"] is not None)

    def give(self, sessions: list[tuple]) -> Iterator[Row]:
        names = [f.split()[0] for f in FOLDED.split(", ")]
        return (_named(names, *s) for s in sessions)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came: dict[str, tuple] = {}
        for document, customer, device, event, t, pay, completes in self.read(key, rows):
            if document not in came:
                came[document] = (customer, device, [t], {})
            _, _, last, events = came[document]
            if t > last[0]:
                last[0] = t
            events[event] = (event, t, pay, completes)
        if came:
            self.events.appendList([(document, customer, device, last[0] + self.gap, *map(list, zip(*events.values())))
                                    for document, (customer, device, last, events) in came.items()])
            self._wake_at(min(last[0] for _, _, last, _ in came.values()) + self.gap)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() if timerValues else float("inf")
        kept, closes = list(self.events.get()), {}
        for document, _, _, until, *_ in kept:
            closes[document] = max(until, closes.get(document, until))
        waiting = [row for row in kept if _millis_after(closes[row[0]]) > passed]
        self.due.clear()
        if not waiting:
            self.events.clear()
        else:
            if len(waiting) < len(kept):
                self.events.put(waiting)
            self._wake_at(min(closes[row[0]] for row in waiting))
        closed: dict[str, tuple] = {}
        for document, customer, device, _, *events in kept:
            if _millis_after(closes[document]) <= passed:
                closed.setdefault(document, (customer, device, {}))[2].update((e[0], e[1:]) for e in zip(*events))   # the last of a replayed one
        out = []
        for document, (customer, device, events) in closed.items():
            times, pays, completes = zip(*events.values())
            start, end = min(times), max(times)
            out.append((document, customer, device, start, end, len(times), sum(pays), any(completes), (end - start) // 1_000_000))
        yield from self.give(out)


class SessionFrames(SessionFold):
    """The fold with a key's rows as pandas frames: a row costs a fraction of what it does as a ``Row``."""

    def read(self, key, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in rows:
            for beat, document, customer, *event in zip(*(frame[c].tolist() for c in (
                    "beat", self.by, "customer_id", "device_type", "event_id", "micros", "pay", "completes"))):
                if not beat:
                    yield document, None if customer is None else int(customer), *event

    def give(self, sessions: list[tuple]) -> Iterator[pd.DataFrame]:
        if sessions:
            yield pd.DataFrame(sessions, columns=[f.split()[0] for f in FOLDED.split(", ")])


def fold_sessions(changes: DataFrame, gap_s: int, delay: str) -> DataFrame:
    """One row per session of a stream of flat session changes (``SESSION_CHANGE``); a session is
    given out when the watermark is ``gap_s`` past its last event."""
    rows = changes.withWatermark("at", delay).select(          # no null in a number: pandas would make it a float
        F.pmod(F.xxhash64("document_id"), F.lit(SESSION_GROUPS)).alias("part"), "at", "document_id",
        F.col("customer_id").cast("string").alias("customer_id"), "device_type", F.col("event_id").isNull().alias("beat"),
        F.coalesce("event_id", F.lit(0)).alias("event_id"), F.coalesce(F.unix_micros("at"), F.lit(0)).alias("micros"),
        F.coalesce(F.col("element") == "pay_button", F.lit(False)).alias("pay"),
        F.coalesce("completes", F.lit(False)).alias("completes"))
    out = rows.groupBy("part").transformWithStateInPandas(SessionFrames(_seconds(gap_s), "document_id"), FOLDED, "Append", "EventTime")
    return out.select("session_id", "customer_id", "device_type", F.timestamp_micros("_s").alias("session_start"),
                      F.timestamp_micros("_e").alias("session_end"), "event_count", "pay_clicks", "converted", "duration_seconds")
