"""Ordered folds per key: greedy acceptance under a cumulative cap.

A rejected item must not count toward the cap, so this is not a running sum. Rows are sorted by
(key, order) inside their tasks and folded as they stream by; a task holds one number, the total
accepted so far of the key at hand, never a key's items.

A key with more than ``chunk`` items is not left to one task. It goes through rounds, each over all such
keys at once, on rows range-partitioned by (key, order):

1. running sums give the accepted prefix: every item up to the first that does not fit;
2. the next ``chunk`` items are folded in a task;
3. later items above the room that is left can never fit and are turned down;
   the others go to the next round.

Room only shrinks, so a few rounds do for most keys; each takes at least ``chunk`` items off every key.
Items with an amount below zero (they give room back) take part; step 3 then allows for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payflow.operators.ranks import group_row_number, group_running_sum
from payflow.operators.tables import stored

CHUNK = 50_000


def _scale(df: DataFrame, *cols: str) -> int:
    kinds = [df.schema[c].dataType for c in cols]
    if not all(isinstance(k, (T.DecimalType, T.IntegerType, T.LongType, T.ShortType)) for k in kinds):
        raise ValueError("amounts and caps must be decimals or integers")
    return max(getattr(k, "scale", 0) for k in kinds)


def _folded(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``accepted`` and ``_used``: the fold of each key's ``_a`` in ``order`` under ``_cap``,
    streamed through tasks that hold whole keys."""
    rows = rows.repartition(key).sortWithinPartitions(key, *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField("_used", T.LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = None, 0
        for batch in batches:
            keys = batch.column(schema.fieldNames().index(key))
            amounts = batch.column(schema.fieldNames().index("_a")).to_pylist()
            caps = batch.column(schema.fieldNames().index("_cap")).to_pylist()
            new = [last is None or keys[0] != last] if len(keys) else []
            if len(keys) > 1:
                new += pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), True).to_pylist()
            accepted, totals = [], []
            for fresh, a, cap in zip(new, amounts, caps):
                if fresh:
                    used = 0
                fits = a is not None and cap is not None and used + a <= cap
                if fits:
                    used += a
                accepted.append(fits)
                totals.append(used)
            if len(keys):
                last = keys[len(keys) - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_()), pa.array(totals, pa.int64())],
                                             names=schema.fieldNames())

    return rows.mapInArrow(fold, schema)


def _hot(rows: DataFrame, key: str, order: list[str], chunk: int) -> DataFrame:
    """As ``_folded``, for keys of any size."""
    rows = stored(group_row_number(rows, [key], order, "_at"), "fold-rows")
    back = -F.sum(F.least(F.col("_a"), F.lit(0)))
    state = stored(rows.groupBy(key).agg(F.first("_cap").alias("_room"), back.alias("_back")), "fold-state")
    left, taken = rows.select(key, "_at", "_a"), []
    while True:
        at = stored(group_running_sum(left, [key], ["_at"], "_a", "_sum", "_rn"), "fold-sums").join(state, key)
        stop = at.groupBy(key).agg(F.min(F.when(F.col("_sum") > F.col("_room"), F.col("_rn"))).alias("_stop"))
        at = stored(at.join(stop, key).select(key, "_at", "_a", "_sum", "_room", "_rn", "_stop"), "fold-prefix")
        prefix = F.col("_stop").isNull() | (F.col("_rn") < F.col("_stop"))
        spent = at.filter(prefix).groupBy(key).agg(F.sum("_a").alias("_spent"))
        part = (at.filter((F.col("_rn") >= F.col("_stop")) & (F.col("_rn") < F.col("_stop") + chunk)).join(spent, key, "left")
                .select(key, "_at", "_a", (F.col("_room") - F.coalesce("_spent", F.lit(0))).alias("_cap")))
        done = stored(_folded(part, key, ["_at"]), "fold-chunk")
        taken += [at.filter(prefix).select(key, "_at"), done.filter("accepted").select(key, "_at")]
        used = spent.unionByName(done.groupBy(key).agg(F.max_by("_used", "_at").alias("_spent")))
        state = stored(state.join(used.groupBy(key).agg(F.sum("_spent").alias("_spent")), key, "left")
                       .withColumn("_room", F.col("_room") - F.coalesce("_spent", F.lit(0))).drop("_spent"), "fold-state")
        left = stored(at.filter(F.col("_rn") >= F.col("_stop") + chunk).select(key, "_at", "_a").join(state, key)
                      .filter(F.col("_a") <= F.col("_room") + F.col("_back")).select(key, "_at", "_a"), "fold-left")
        if left.isEmpty():
            break
    accepted = taken[0]
    for more in taken[1:]:
        accepted = accepted.unionByName(more)
    marked = (rows.join(accepted.withColumn("accepted", F.lit(True)), [key, "_at"], "left")
              .withColumn("accepted", F.coalesce("accepted", F.lit(False)))
              .withColumn("_take", F.when(F.col("accepted"), F.col("_a")).otherwise(F.lit(0).cast("long"))))
    return group_running_sum(marked, [key], ["_at"], "_take", "_used").drop("_at", "_take")


def greedy_cap(df: DataFrame, key: str, order: list[str], amount: str, cap: str,
               item_cols: list[str], chunk: int = CHUNK) -> DataFrame:
    """Accept items of each ``key`` in ``order`` (unique in a key) while accepted total + amount <= cap.

    ``cap`` is a per-key column (same on every row of a key); a null cap or amount accepts nothing. Output: one row
    per item with ``accepted`` and ``accepted_total_after`` (running total of accepted amounts). Rows without a key
    are left out."""
    scale = _scale(df, amount, cap)
    unit = F.lit(10 ** scale)
    columns = list(dict.fromkeys([key, *order, *item_cols, amount]))
    rows = (df.filter(F.col(key).isNotNull())
            .select(*columns, (F.col(amount) * unit).cast("long").alias("_a"), (F.col(cap) * unit).cast("long").alias("_cap")))
    large = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk).select(key)
    large = stored(large, "fold-large")
    if large.isEmpty():
        out = _folded(rows, key, order)
    else:
        out = (_folded(rows.join(large, key, "left_anti"), key, order)
               .unionByName(_hot(rows.join(large, key, "left_semi"), key, order, chunk)))
    total = (F.col("_used").cast("decimal(38,0)") / unit.cast("decimal(38,0)")).cast(f"decimal(38,{max(scale, 2)})")
    return out.select(*columns, "accepted", total.alias("accepted_total_after"))
