"""Window operators: running totals, lags, range frames that survive hot keys.

Range frames (``count in the last hour``) partition by the entity key. When one key
holds a large share of the rows, a plain ``Window.partitionBy(key)`` puts all of it
in one task. ``range_frame_aggs`` splits each key by time bucket instead: every row
is processed in its own bucket, and the rows of the previous bucket that fall inside
the look-back are copied in as context (read-only) rows. A bucket is at least as wide
as the look-back, so each frame is complete; the copy overhead is look-back / width.
Inside a (key, bucket), counts, sums and distinct counts come from one pass over the sorted rows
(``_frame_pass``); other aggregates use Spark's sliding frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


COUNT = "count"
"""Frame builder marker: a row count over the frame, computed by binary search (see ``_frame_pass``)."""


def _bucketed(df: DataFrame, ts: str, lookback_us: int, width_s: int) -> DataFrame:
    """Rows with ``_t`` (micros), ``_b`` (time bucket) and ``_ctx`` (read-only context copy)."""
    W = int(width_s) * 1_000_000
    if W < lookback_us:
        raise ValueError("bucket must be at least as wide as the look-back")
    t = micros(ts)
    b = F.floor(t / W).cast("long")
    # each row: its own bucket (target); if within the look-back of the next bucket start,
    # also a context copy there
    copies = F.when(t + lookback_us >= (b + 1) * W,
                    F.array(F.struct(b.alias("_b"), F.lit(False).alias("_ctx")),
                            F.struct((b + 1).alias("_b"), F.lit(True).alias("_ctx")))) \
        .otherwise(F.array(F.struct(b.alias("_b"), F.lit(False).alias("_ctx"))))
    return (df.withColumn("_t", t).withColumn("_c", F.explode(copies))
            .withColumn("_b", F.col("_c._b")).withColumn("_ctx", F.col("_c._ctx")).drop("_c"))


def distinct_count(col: str) -> tuple[str, str]:
    """Frame builder marker: number of distinct non-null ``col`` values in the frame
    (``COUNT(DISTINCT col)``), computed linearly (see ``_frame_pass``)."""
    return ("distinct", col)


def frame_sum(col: str) -> tuple[str, str]:
    """Frame builder marker: the sum of a DECIMAL (or integer) ``col`` over the frame, exact and linear: the difference
    of two running sums (see ``_frame_pass``); 0 in an empty frame."""
    return ("sum", col)


HALF = 10**9                          # sums are added up in two halves, so no running sum leaves 64 bits
FRAME_ROWS = 50_000                   # rows that are worked on together


def _unscaled(df: DataFrame, col: str) -> tuple[Column, int, str]:
    """(a sum's values as whole numbers, their decimal places, type of the sum)."""
    kind = df.schema[col].dataType
    if not isinstance(kind, T.DecimalType):
        return F.col(col).cast("decimal(19,0)"), 0, "bigint"
    if kind.precision > 27 or kind.scale > 6:
        raise ValueError(f"{col}: sums over frames take at most 27 digits, 6 of them decimal places")
    whole = (F.col(col) * F.lit(Decimal(10**kind.scale))).cast("decimal(27,0)")
    return whole, kind.scale, f"decimal({min(38, kind.precision + 11)},{kind.scale})"


def _differs(col: pa.ChunkedArray) -> np.ndarray:
    """Where a value is not that of the row before (nulls are equal)."""
    now, before = col.slice(1), col.slice(0, len(col) - 1)
    gone, came = pc.is_null(before).to_numpy(), pc.is_null(now).to_numpy()
    return pc.fill_null(pc.not_equal(now, before), False).to_numpy() | (gone != came)


def _frame_columns(table: pa.Table, part: list[str], width: int, longest: int, counts: dict, distinct: dict, sums: dict,
                   peers: bool) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(place on one time line, frame columns) of rows sorted by (part, time).

    The (key, bucket) groups lie one after another on the line, further apart than a look-back, so a frame is
    a range of rows found by binary search and never reaches into another group."""
    n = table.num_rows
    fresh = np.zeros(n, dtype=bool)
    for c in part:
        fresh[1:] |= _differs(table[c])
    no_time = pc.is_null(table["_t"]).to_numpy()
    t, b = (pc.fill_null(table[c], 0).to_numpy() for c in ("_t", "_b"))
    at = np.cumsum(fresh) * _span(width, longest) + np.where(no_time, 0, t - b * width + longest)
    low: dict[int, np.ndarray] = {}

    def frame(back: int, include: bool) -> tuple[np.ndarray, np.ndarray]:
        if back not in low:
            low[back] = np.searchsorted(at, at - back, "left")
        return low[back], np.searchsorted(at, at, "right" if include else "left")

    out = {}
    for name, (back, include) in counts.items():
        lo, hi = frame(back, include)
        out[name] = hi - lo
    for name, (back, include, col) in sums.items():
        lo, hi = frame(back, include)
        for half in ("_hi_", "_lo_"):
            run = np.concatenate([[0], np.cumsum(pc.fill_null(table[half + col], 0).to_numpy())])
            out[half + name] = run[hi] - run[lo]
    for name, (back, col) in distinct.items():
        # a value covers [t, t + back]; its occurrences at most back apart make one interval
        own = np.flatnonzero(pc.is_valid(table[col]).to_numpy() & ~no_time)
        code = table[col].take(pa.array(own)).combine_chunks().dictionary_encode()
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
        order = np.lexsort((at[own], code))
        place, code = at[own][order], code[order]
        first = np.ones(len(own), dtype=bool)
        first[1:] = (code[1:] != code[:-1]) | (np.diff(place) > back)
        last = np.ones(len(own), dtype=bool)
        last[:-1] = first[1:]
        out[name] = (np.searchsorted(np.sort(place[first]), at, "right")
                     - np.searchsorted(np.sort(place[last] + back), at, "left"))
    for values in out.values():
        values[no_time] = 0
    if peers:
        out["_peer_rn"] = np.arange(n) - np.searchsorted(at, at, "left") + 1
    return at, out


def _span(width: int, longest: int) -> int:
    return width + 3 * longest + 2


def _frame_pass(x: DataFrame, keys: list[str], width: int, longest: int, counts: dict[str, tuple[int, bool]],
                distinct: dict[str, tuple[int, str]], sums: dict[str, tuple[int, bool, str]], peer_order: str | None,
                context: bool) -> DataFrame:
    """Range-frame counts, sums, distinct counts and peer numbers in one shuffle and one pass over sorted rows.

    Spark evaluates a sliding RANGE frame by re-aggregating the rows in the frame for every output row, so a dense
    key costs rows x frame size. Here rows are dealt out by (key, bucket) and sorted by time; a task walks over
    them a few thousand at a time, finds the ends of every frame by binary search, and keeps of a group only the rows
    inside the longest look-back of the last one (and those at its time, whose frames are not complete yet).

    ``counts``: name -> (look-back micros, include_current); ``distinct``: name -> (look-back micros, column);
    ``sums``: name -> (look-back, include_current, column). ``context``: give out the context rows too."""
    part = [*keys, "_b"]
    summed = {c: _unscaled(x, c) for c in sorted({c for _, _, c in sums.values()})}
    names = x.columns
    for c, (whole, _, _) in summed.items():
        half = F.lit(Decimal(HALF))
        x = x.withColumns({f"_lo_{c}": (whole % half).cast("long"), f"_hi_{c}": ((whole - whole % half) / half).cast("long")})
    order = [*part, "_t", *([peer_order] if peer_order else [])]
    rows = x.repartition(*[F.col(c) for c in part]).sortWithinPartitions(*order)
    made = [*counts, *[h + n for n in sums for h in ("_hi_", "_lo_")], *distinct, *(["_peer_rn"] if peer_order else [])]
    kept = [c for c in names if context or c not in ("_t", "_b", "_ctx")]
    schema = T.StructType([*[x.schema[c] for c in kept], *[T.StructField(n, T.LongType()) for n in made]])
    most = max(1, min(FRAME_ROWS, 2**62 // _span(width, longest) - 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, given = None, 0                                 # rows kept, of which so many are given out already

        def step(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, given
            at, found = _frame_columns(held, part, width, longest, counts, distinct, sums, peer_order is not None)
            ready = len(at) if last else int(np.searchsorted(at, at[-1], "left"))
            out = held.select(kept)
            for n in made:
                out = out.append_column(n, pa.array(found[n], type=pa.int64()))
            out = out.slice(given, ready - given)
            if not context:
                out = out.filter(pc.invert(held["_ctx"].slice(given, ready - given)))
            yield from out.combine_chunks().to_batches()
            start = int(np.searchsorted(at, at[-1] - longest, "left"))
            held, given = held.slice(start).combine_chunks(), ready - start

        fresh: list[pa.RecordBatch] = []
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                fresh.append(batch.slice(i, most))
                if sum(f.num_rows for f in fresh) >= most // 2:
                    held, fresh = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches(fresh)]), []
                    yield from step(False)
        if fresh:
            held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches(fresh)])
        if held is not None and held.num_rows > given:
            yield from step(True)

    out = rows.mapInArrow(run, schema)
    for n, (_, _, c) in sums.items():
        _, scale, kind = summed[c]
        total = F.col(f"_hi_{n}").cast("decimal(19,0)") * F.lit(Decimal(HALF)) + F.col(f"_lo_{n}").cast("decimal(19,0)")
        out = out.withColumn(n, (total * F.lit(Decimal(1).scaleb(-scale)) if scale else total).cast(kind)).drop(f"_hi_{n}", f"_lo_{n}")
    return out


def _apply_frames(x: DataFrame, keys: list[str], frames: dict[str, tuple[int, bool, object]],
                  peer_order: str | None, width: int) -> DataFrame:
    counts = {n: (lb, incl) for n, (lb, incl, fn) in frames.items() if isinstance(fn, str) and fn == COUNT}
    sums = {n: (lb, incl, fn[1]) for n, (lb, incl, fn) in frames.items() if isinstance(fn, tuple) and fn[0] == "sum"}
    distinct = {}
    for n, (lb, incl, fn) in frames.items():
        if isinstance(fn, tuple) and fn[0] == "distinct":
            if not incl:
                raise ValueError("distinct_count frames include the current row")
            distinct[n] = (lb, fn[1])
    sliding = {n: f for n, f in frames.items() if n not in counts and n not in sums and n not in distinct}
    if counts or distinct or sums or peer_order:
        longest = max(lb for lb, _, _ in frames.values())
        x = _frame_pass(x, keys, width, longest, counts, distinct, sums, peer_order, bool(sliding))
        if not sliding:
            return x
    base = Window.partitionBy(*keys, "_b").orderBy("_t")
    for name, (lb, incl, fn) in sliding.items():
        x = x.withColumn(name, fn(base.rangeBetween(-lb, 0 if incl else -1)))
    return x.filter(~F.col("_ctx")).drop("_t", "_b", "_ctx")


def range_frame_aggs(df: DataFrame, keys: list[str], ts: str, lookback_s: int,
                     aggs: dict[str, Callable[[Window], Column] | str], *, include_current: bool = True,
                     bucket_s: int | None = None, peer_order: str | None = None) -> DataFrame:
    """Add one column per ``aggs`` entry, computed over rows of the same ``keys`` whose
    time is in ``[ts - lookback_s, ts]`` (``include_current``) or ``[ts - lookback_s, ts)``.

    ``aggs`` maps a column name to ``COUNT`` (row count, linear time) or to a
    ``lambda w: F.avg("x").over(w)``-style builder (a sliding frame).
    With ``peer_order``, ``_peer_rn`` is added: the row number among rows of the same key
    and the same instant, ordered by ``peer_order`` (same partitioning, no extra shuffle).
    """
    L = int(lookback_s) * 1_000_000
    width = int(bucket_s or max(lookback_s * 4, 86_400))
    x = _bucketed(df, ts, L, width)
    return _apply_frames(x, keys, {n: (L, include_current, fn) for n, fn in aggs.items()}, peer_order, width * 1_000_000)


def multi_range_frame_aggs(df: DataFrame, keys: list[str], ts: str,
                           frames: dict[str, tuple[int, bool, Callable[[Window], Column] | str]],
                           bucket_s: int | None = None, peer_order: str | None = None) -> DataFrame:
    """Several range frames of different look-backs in one pass (one shuffle).

    ``frames`` maps name -> (lookback_s, include_current, ``COUNT``, ``frame_sum``, ``distinct_count`` or a builder). The bucket
    width is at least the largest look-back, so every frame is complete.
    """
    L_max = max(lb for lb, _, _ in frames.values())
    width = int(bucket_s or max(L_max * 4, 86_400))
    x = _bucketed(df, ts, L_max * 1_000_000, width)
    return _apply_frames(x, keys, {n: (int(lb) * 1_000_000, incl, fn) for n, (lb, incl, fn) in frames.items()},
                         peer_order, width * 1_000_000)


def count_in_range(df: DataFrame, keys: list[str], ts: str, lookback_s: int, name: str = "n_in_range",
                   bucket_s: int | None = None) -> DataFrame:
    """SQL ``COUNT(*) OVER (PARTITION BY keys ORDER BY ts RANGE BETWEEN lookback PRECEDING AND CURRENT ROW)``."""
    return range_frame_aggs(df, keys, ts, lookback_s, {name: COUNT}, bucket_s=bucket_s)


def prior_count(df: DataFrame, keys: list[str], ts: str, tiebreak: str, lookback_s: int,
                name: str = "prior_n", bucket_s: int | None = None) -> DataFrame:
    """Earlier rows of the same key within ``lookback_s`` (bound inclusive), current row excluded.

    "Earlier" follows (ts, tiebreak) order: rows at the same instant count when their
    tiebreak is smaller. = count over [ts-L, ts) + peers at ts with a smaller tiebreak.
    """
    out = range_frame_aggs(df, keys, ts, lookback_s,
                           {"_before": COUNT},
                           include_current=False, bucket_s=bucket_s, peer_order=tiebreak)
    return (out.withColumn(name, F.col("_before") + F.col("_peer_rn") - 1)
            .drop("_before", "_peer_rn"))


def seen_before(df: DataFrame, keys: list[str], ts: str, tiebreak: str, name: str = "seen_before") -> DataFrame:
    """True when an earlier row (ts, tiebreak order) exists for the same ``keys``.

    Computed as ``min`` per key and a comparison, which is a partial aggregate, not a
    per-key sort: safe when one key is hot.
    """
    first = (df.groupBy(*keys).agg(F.min(F.struct(F.col(ts), F.col(tiebreak))).alias("_first")))
    return (df.join(first, keys, "left")
            .withColumn(name, F.struct(F.col(ts), F.col(tiebreak)) != F.col("_first"))
            .drop("_first"))


def running_total(df: DataFrame, value: Column | str, part: list[str], order: list[str],
                  name: str = "running_total") -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep, per key, the row with the greatest ``order`` tuple (e.g. the highest LSN).

    Implemented as ``max_by`` of the whole row on a partial aggregate: map-side
    combine keeps only one candidate per key per partition, so a hot key costs one
    row of shuffle per partition, not its full history.
    """
    cols = [c for c in df.columns]
    sort_key = F.struct(*order)
    agg = (df.groupBy(*keys)
           .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), sort_key).alias("_row")))
    return agg.select("_row.*")


def burst_starts(df: DataFrame, keys: list[str], ts: str, window_s: int, more_than: int,
                 bucket_s: int | None = None) -> DataFrame:
    """Bursts of more than ``more_than`` rows of one key within ``window_s`` seconds, each once: (keys,
    first_event, detected_at, events) at the first time whose frame ``[t - window, t]`` is over the number
    while the time before it, if inside the frame, was not. Linear in the rows; a hot key is split by time
    bucket. Rows at one time count together."""
    w_us = int(window_s) * 1_000_000
    # the row before lies inside the window and has a whole frame of its own: twice the window as context
    x = _bucketed(df.select(*keys, ts), ts, 2 * w_us, int(bucket_s or max(window_s * 8, 86_400)))
    at = x.groupBy(*keys, "_b", "_t", "_ctx").agg(F.count(F.lit(1)).alias("_n"))
    part = [*keys, "_b"]
    events = (at.withColumn("_ev", F.lit(0)).unionByName(
        at.withColumns({"_t": F.col("_t") + w_us, "_ev": F.lit(1)})))
    upto = Window.partitionBy(*part).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    rows = lambda ev, w: F.coalesce(F.sum(F.when(F.col("_ev") == ev, F.col("_n"))).over(w), F.lit(0))
    counted = events.withColumn("events", rows(0, upto) - rows(1, before)).filter(F.col("_ev") == 0)
    order = Window.partitionBy(*part).orderBy("_t")
    last_t, last_n = F.lag("_t").over(order), F.lag("events").over(order)
    # where a burst starts, the row before is not over the number: the frame has few earlier times
    near = F.collect_list("_t").over(order.rowsBetween(-more_than, 0))
    marked = counted.withColumns({"_last_t": last_t, "_last_n": last_n, "_near": near})
    first = F.array_min(F.filter("_near", lambda t: t >= F.col("_t") - w_us))
    fresh = F.col("_last_t").isNull() | (F.col("_last_t") < F.col("_t") - w_us) | (F.col("_last_n") <= more_than)
    return (marked.filter(~F.col("_ctx") & (F.col("events") > more_than) & fresh)
            .select(*keys, F.timestamp_micros(first).cast("timestamp_ntz").alias("first_event"),
                    F.timestamp_micros("_t").cast("timestamp_ntz").alias("detected_at"), "events"))
