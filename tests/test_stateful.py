"""Stateful streams: per-event ranges and bursts equal their batch twins, whatever the order of arrival."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from payflow.operators.windows import burst_starts, count_in_range
from payflow.streaming import stateful as ST

T0 = dt.datetime(2024, 1, 1)
FAR = dt.datetime(2024, 3, 1)
SCHEMA = "ip string, ts timestamp"


def _brute_bursts(rows, window, more):
    out = []
    for key in {k for k, _ in rows}:
        times = sorted(t for k, t in rows if k == key)
        above_at = None
        for t in sorted(set(times)):
            inside = [u for u in times if 0 <= (t - u).total_seconds() <= window]
            held = above_at is not None and (t - above_at[0]).total_seconds() <= window and above_at[1]
            above = len(inside) > more
            if above and not held:
                out.append((key, inside[0], t, len(inside)))
            above_at = (t, above)
    return sorted(out)


def _events(seed, n=160):
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.4 else f"10.0.0.{r.randrange(4)}", T0 + dt.timedelta(seconds=r.randrange(0, 2400) // 3 * 3))
            for _ in range(n)]
    # a burst over the border of a minute, and one of equal times
    return rows + [("edge", T0 + dt.timedelta(seconds=s)) for s in (40, 50, 55, 65, 70, 80)] + [("same", T0)] * 7


def _stream(spark, tmp, rows, name, files=1):
    """Files by arrival: each holds a slice of time, out of order inside; the last one moves the watermark on."""
    src = os.path.join(tmp, name)
    rows = sorted(rows, key=lambda x: x[1])
    step = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * step:(i + 1) * step]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("end", FAR)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


def _run(spark, tmp, out, name):
    with ST.rocksdb_state(spark):
        q = (out.writeStream.format("parquet").option("path", os.path.join(tmp, f"{name}-out"))
             .option("checkpointLocation", os.path.join(tmp, f"{name}-ck")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    return spark.read.parquet(os.path.join(tmp, f"{name}-out"))


def test_batch_bursts_like_brute_force(spark):
    rows = _events(3, 400)
    df = spark.createDataFrame(rows, "ip string, ts timestamp_ntz")
    for window, more, bucket in ((60, 5, 120), (60, 5, None), (300, 2, 600)):
        got = sorted(tuple(r) for r in burst_starts(df, ["ip"], "ts", window, more, bucket).collect())
        assert got == _brute_bursts(rows, window, more) and len(got) > 3
    assert burst_starts(df.limit(0), ["ip"], "ts", 60, 5).count() == 0


@pytest.mark.parametrize("files", [1, 4])
def test_stream_reports_each_burst_once(spark, tmp, files):
    rows = _events(5)
    got = _run(spark, tmp, ST.burst_stream(_stream(spark, tmp, rows, "b", files), "ip", "ts", 60, 5, "10 minutes"), "b")
    assert sorted(tuple(r) for r in got.collect()) == _brute_bursts(rows, 60, 5)
    assert "edge" in {r.ip for r in got.collect()}


def test_stream_counts_equal_the_batch_range_frame(spark, tmp):
    rows = _events(7)
    got = _run(spark, tmp, ST.sliding_counts(_stream(spark, tmp, rows, "c", 3), "ip", "ts", {"n_60": 60, "n_600": 600}), "c")
    df = spark.createDataFrame(rows, SCHEMA)
    for name, s in (("n_60", 60), ("n_600", 600)):
        batch = count_in_range(df, ["ip"], "ts", s, "n").distinct().withColumnRenamed("n", name)
        mine = got.filter(F.col("ip") != "end").select("ip", "ts", name)
        assert batch.exceptAll(mine).count() == 0 and mine.exceptAll(batch).count() == 0


def test_late_events_behind_the_watermark_are_dropped(spark, tmp):
    src = os.path.join(tmp, "l")
    for part in ([("a", T0 + dt.timedelta(seconds=s)) for s in range(4)], [("b", T0 + dt.timedelta(hours=1))],
                 [("b", T0 + dt.timedelta(hours=2))], [("a", T0 + dt.timedelta(seconds=s)) for s in range(4, 8)], [("end", FAR)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    assert _run(spark, tmp, ST.burst_stream(s, "ip", "ts", 60, 5, "1 minute"), "l").count() == 0


def _session(i, customer, times, page=0):
    return [(f"s{i}", customer, "mobile", 100 * i + page + k, "pay_button" if k % 2 else "link", k == 2, t) for k, t in enumerate(times)]


def test_sessions_with_replays_and_late_pushes(spark, tmp):
    src, minute = os.path.join(tmp, "docs"), dt.timedelta(minutes=1)
    a = _session(1, 7, [T0, T0 + 3 * minute, T0 + 5 * minute])
    b = _session(2, 8, [T0 + minute])
    late = _session(1, 7, [T0 + 2 * minute], page=50)                    # after the session was closed
    beat = [("beat", 0, "", 0, "link", False, FAR)]
    parts = [a[:2] + b, a, [("s3", 9, "mobile", 900, "link", False, T0 + 60 * minute)],
             [("s3", 9, "mobile", 900, "link", False, T0 + 60 * minute)], late, beat]
    for part in parts:                                                   # a[:2] and the event of s3 come twice
        spark.createDataFrame(part, ST.SESSION_CHANGE).coalesce(1).write.mode("append").parquet(src)
    changes = spark.readStream.schema(ST.SESSION_CHANGE).option("maxFilesPerTrigger", 1).parquet(src)
    got = _run(spark, tmp, ST.fold_sessions(changes, 600, "5 minutes"), "docs")
    assert sorted(tuple(r) for r in got.collect()) == [
        ("s1", 7, "mobile", T0, T0 + 5 * minute, 3, 1, True, 300), ("s2", 8, "mobile", T0 + minute, T0 + minute, 1, 0, False, 0),
        ("s3", 9, "mobile", T0 + 60 * minute, T0 + 60 * minute, 1, 0, False, 0)]


def test_a_session_takes_its_events_in_one_state_call():
    """Every state call is a round trip: their number must not grow with the events of a batch."""
    from payflow.streaming.stateful import SessionFold
    calls, kept = [], []

    class State:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return iter(kept) if self.value is None else self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def appendList(self, rows):
            calls.append("append")
            kept.extend(rows)

        def updateValue(self, key, value):
            calls.append("updateValue")

        def clear(self):
            kept.clear()

    class Handle:
        def getListState(self, *_):
            return State()

        getMapState = getValueState = getListState

        def registerTimer(self, at):
            calls.append("timer")

        def deleteTimer(self, at):
            calls.append("timer")

    fold = SessionFold(1_000_000)
    fold.init(Handle())
    row = {"customer_id": 1, "device_type": "web", "element": "pay_button", "completes": False}
    list(fold.handleInputRows(("s",), iter([{**row, "event_id": i % 50, "_t": (i % 50) * 1_000_000} for i in range(100)]), None))
    list(fold.handleInputRows(("s",), iter([{**row, "event_id": 7, "_t": 7_000_000, "completes": True}]), None))
    assert len(calls) < 10
    (out,) = fold.handleExpiredTimer(("s",), None, None)
    assert (out["event_count"], out["pay_clicks"], out["converted"], out["duration_seconds"]) == (50, 50, True, 49)


def test_sessions_of_a_group_share_their_state_calls():
    """The number of state calls must not grow with the sessions of a group; open sessions stay, closed ones are given out."""
    from payflow.streaming.stateful import SessionFold
    calls = []

    class State:
        value, rows = None, ()

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return iter(self.rows) if self.value is None else self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def appendList(self, rows):
            calls.append("append")
            self.rows = [*self.rows, *rows]

        def put(self, rows):
            calls.append("put")
            self.rows = list(rows)

        def clear(self):
            calls.append("clear")
            self.value, self.rows = None, ()

    class Handle:
        timers = []

        def getListState(self, *_):
            return State()

        getValueState = getListState

        def registerTimer(self, at):
            calls.append("timer")
            self.timers.append(at)

        def deleteTimer(self, at):
            calls.append("timer")
            self.timers.remove(at)

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    fold, handle = SessionFold(10_000_000, "document_id"), Handle()
    fold.init(handle)
    event = {"customer_id": 1, "device_type": "web", "element": "pay_button", "completes": False}
    rows = [{**event, "document_id": f"s{i}", "event_id": j, "_t": (i + j) * 1_000_000} for i in range(100) for j in range(3)]
    assert not list(fold.handleInputRows((5,), iter(rows), Clock(0))) and handle.timers == [12_000]
    list(fold.handleInputRows((5,), iter([{**event, "document_id": "s0", "event_id": 9, "_t": 9_000_000},
                                          {**event, "document_id": "beat", "event_id": None, "_t": 0}]), Clock(0)))
    handle.timers.clear()
    early = list(fold.handleExpiredTimer((5,), Clock(18_999), None))
    assert sorted(r["session_id"] for r in early) == [f"s{i}" for i in range(1, 7)] and handle.timers == [19_000]
    late = list(fold.handleExpiredTimer((5,), Clock(1_000_000), None))
    assert len(calls) < 30 and len(late) == 94 and fold.events.rows == ()
    (first,) = [r for r in late if r["session_id"] == "s0"]
    assert (first["event_count"], first["duration_seconds"]) == (4, 9)
