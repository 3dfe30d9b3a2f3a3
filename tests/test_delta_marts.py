"""Delta-maintained mart equals the rebuild, whatever the order of batches, replays and crashes."""

import datetime as dt
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from payflow.sources.sinks import read_state
from payflow.streaming import marts as M

SCHEMA = ("transaction_id long, merchant_id long, currency_code string, status string, amount decimal(14,2), "
          "created_at timestamp_ntz, lsn long, op string, ingested_at timestamp_ntz")
T0 = dt.datetime(2024, 1, 1)


def _changes(n=60, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        day = T0 + dt.timedelta(days=r.randrange(3), hours=r.randrange(24))
        for step in range(r.randrange(1, 5)):
            op = "d" if step == 3 else "c" if step == 0 else "u"
            out.append((i, r.randrange(3), r.choice(["EUR", "USD"]), r.choice(["pending", "succeeded", "failed"]),
                        Decimal(r.randrange(1, 10**6)) / 100, day, i * 10 + step, op, T0))
    return out


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _mart(df):
    return sorted(tuple(r) for r in df.select(*M.BY, *M.MEASURES).collect())


def _expected(rows):
    last = {}
    for row in sorted(rows, key=lambda x: x[6]):
        last[row[0]] = row
    out = {}
    for _, merchant, cur, status, amount, at, _, op, _ in last.values():
        if op != "d":
            m = out.setdefault((at.date(), merchant, cur), [0, 0, 0, Decimal("0.00")])
            m[0] += 1
            m[1] += status == "succeeded"
            m[2] += status == "failed"
            m[3] += amount if status == "succeeded" else 0
    return sorted((*k, *v) for k, v in out.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_with_replays_and_compaction(spark, tmp, seed):
    rows = _changes(seed=seed)
    mixed = rows + rows[::7]                                           # some changes arrive twice
    random.Random(seed).shuffle(mixed)                                # an update before its insert, a delete first
    state, deltas = os.path.join(tmp, "state"), os.path.join(tmp, "deltas")
    parts = [mixed[i::5] for i in range(5)]
    for i, part in enumerate(parts):
        M.apply_delta(_rows(spark, part), str(i), state, deltas, "r", 4)
        assert _mart(M.read_mart(spark, deltas)) == _expected([x for p in parts[:i + 1] for x in p])
        if i == 1:
            M.apply_delta(_rows(spark, part), str(i), state, deltas, "r", 4)        # runs again after both steps
        if i == 2:
            M.compact(spark, deltas)
            M.apply_delta(_rows(spark, parts[0]), "0", state, deltas, "other", 4)   # the same changes by another stream
    assert _mart(M.read_mart(spark, deltas)) == _expected(rows)
    held = read_state(spark, state, ["transaction_id"], [F.col("lsn")])
    assert _mart(M.rebuilt(held)) == _expected(rows)


def test_crashes_between_the_steps(spark, tmp, monkeypatch):
    rows = _changes(30, 3)
    state, deltas = os.path.join(tmp, "state"), os.path.join(tmp, "deltas")
    M.apply_delta(_rows(spark, rows[:40]), "0", state, deltas, "r", 4)
    real = M.upsert
    monkeypatch.setattr(M, "upsert", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        M.apply_delta(_rows(spark, rows[40:]), "1", state, deltas, "r", 4)          # delta written, state not
    monkeypatch.setattr(M, "upsert", real)
    M.apply_delta(_rows(spark, rows[40:]), "1", state, deltas, "r", 4)
    assert _mart(M.read_mart(spark, deltas)) == _expected(rows)
    M.apply_delta(_rows(spark, rows[40:]), "1", state, deltas, "r", 4)              # again, after the state too
    M.compact(spark, deltas)
    (base,) = [b for b in os.listdir(deltas) if b.startswith("base=")]
    os.remove(os.path.join(deltas, base, M.DONE))                      # a base that was not finished does not count
    assert M.read_mart(spark, deltas) is None
    M.apply_delta(_rows(spark, rows[40:]), "1", state, os.path.join(tmp, "d2"), "r", 4)
    assert _mart(M.read_mart(spark, os.path.join(tmp, "d2"))) == []    # nothing new against the state


def test_a_batch_is_read_once(spark, tmp):
    """The delta and the state take the same parsed rows: parsing is the dear step of a batch."""
    seen = spark.sparkContext.accumulator(0)
    rows = _changes(40)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    M.apply_delta(_rows(spark, rows).mapInArrow(count, SCHEMA), "0", f"{tmp}/s", f"{tmp}/d")
    assert seen.value == len(rows)
    assert _mart(M.read_mart(spark, f"{tmp}/d")) == _expected(rows)
