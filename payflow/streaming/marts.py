"""Micro-batch marts by deltas (K12): a batch of changes retracts the images it replaces and adds the new ones.

Per micro-batch, only payments that it touches are looked up in the change-log state (key buckets that it does not
touch are not read); the mart's change is the aggregate of their new images less that of their old ones. Deltas
are added up on read, so batches may come in any order and late older changes cancel out to nothing.

A batch writes its delta, then its rows into the state. A delta that is complete is never computed again, so a batch
that runs again after either step adds nothing twice. ``compact`` sums deltas into a base that names the batches in
it; a base counts only once it is marked as complete, and the batches it names are left out from then on, whether
or not their folders are gone already.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from payflow.operators.windows import latest_per_key
from payflow.sources.sinks import STATE_BUCKETS, _exists, _fs, read_log, upsert
from payflow.streaming.jobs import cdc_stream, run_identity

KEY, ORDER = "transaction_id", "lsn"
BY = ["day", "merchant_id", "currency_code"]
MEASURES = ["transaction_count", "succeeded_count", "failed_count", "total_amount"]
DONE = "_done"


def contributions(rows: DataFrame, sign: int = 1) -> DataFrame:
    """What live payments add to (``sign`` 1) or take from (-1) the mart, per row."""
    ok = F.col("status") == "succeeded"
    live = rows.filter(~F.coalesce(F.col("_deleted"), F.lit(False)))
    unit = lambda cond: F.when(cond, F.lit(sign)).otherwise(F.lit(0)).cast("long")
    return live.select(F.to_date("created_at").alias("day"), "merchant_id", "currency_code",
                       F.lit(sign).cast("long").alias("transaction_count"), unit(ok).alias("succeeded_count"),
                       unit(F.col("status") == "failed").alias("failed_count"),
                       (F.when(ok, F.col("amount")).otherwise(F.lit(0)) * sign).cast("decimal(28,2)").alias("total_amount"))


def _summed(rows: DataFrame) -> DataFrame:
    total = rows.groupBy(*BY).agg(*[F.sum(m).cast(rows.schema[m].dataType).alias(m) for m in MEASURES])
    nothing: Column = F.lit(True)
    for m in MEASURES:
        nothing = nothing & (F.col(m) == 0)
    return total.filter(~nothing)


def rebuilt(state: DataFrame) -> DataFrame:
    """The mart from scratch, from the latest images (``_deleted`` ones are left out)."""
    return _summed(contributions(state))


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def apply_delta(batch: DataFrame, name: str, state: str, deltas: str, run: str = "", buckets: int = STATE_BUCKETS) -> None:
    """One batch of typed changes (``jobs.usable_changes``) into the deltas and the state, under ``run`` and ``name``."""
    spark = batch.sparkSession
    changes = batch.withColumn("_deleted", F.col("op") == "d").drop("ingested_at")
    path = f"{deltas.rstrip('/')}/batch={run}-{name}"
    changes = changes.persist()                              # parsed once, for the delta and for the state
    if not _exists(spark, f"{path}/_SUCCESS"):
        latest = latest_per_key(changes, [KEY], [F.col(ORDER)])
        touched = [r[0] for r in changes.select(F.pmod(F.xxhash64(KEY), F.lit(buckets))).distinct().collect()]   # bucket numbers
        log = read_log(spark, state)
        add = contributions(latest)
        if log is not None:
            near = (log.filter(F.col("bucket").isin(touched)).drop("level", "batch", "bucket")
                    .join(latest.select(KEY), KEY, "left_semi"))
            old = latest_per_key(near, [KEY], [F.col(ORDER)])
            new = latest_per_key(old.unionByName(latest), [KEY], [F.col(ORDER)])
            add = contributions(new).unionByName(contributions(old, -1))
        _summed(add).write.mode("overwrite").parquet(path)
    upsert(spark, state, changes, [KEY], [F.col(ORDER)], name, buckets, run)
    changes.unpersist()


def _bases(spark: SparkSession, deltas: str) -> tuple[str | None, set[str]]:
    """(path, names of the batches in it) of the newest complete base."""
    best, held = None, set()
    for b in _children(spark, deltas):
        path = f"{deltas.rstrip('/')}/{b}"
        if b.startswith("base=") and DONE in _children(spark, path):
            names = {r[0] for r in spark.read.parquet(f"{path}/names").collect()}              # batch names
            if best is None or len(names) > len(held):
                best, held = path, names
    return best, held


def read_mart(spark: SparkSession, deltas: str) -> DataFrame | None:
    """The mart: the base and the deltas that it does not hold, added up."""
    base, held = _bases(spark, deltas)
    open_ = [f"{deltas.rstrip('/')}/{b}" for b in _children(spark, deltas) if b.startswith("batch=") and b not in held
             and "_SUCCESS" in _children(spark, f"{deltas.rstrip('/')}/{b}")]
    parts = ([f"{base}/rows"] if base else []) + open_
    return _summed(spark.read.parquet(*parts).select(*BY, *MEASURES)) if parts else None


def compact(spark: SparkSession, deltas: str) -> None:
    """Sum the base and all complete deltas into a new base, then drop what it holds."""
    base, held = _bases(spark, deltas)
    fs, _ = _fs(spark, deltas)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fresh = [b for b in _children(spark, deltas) if b.startswith("batch=") and b not in held
             and "_SUCCESS" in _children(spark, f"{deltas.rstrip('/')}/{b}")]
    if fresh:
        new = f"{deltas.rstrip('/')}/base={uuid.uuid4().hex[:12]}"
        read_mart(spark, deltas).write.parquet(f"{new}/rows")
        spark.createDataFrame([(b,) for b in sorted(held | set(fresh))], "name string").coalesce(1).write.parquet(f"{new}/names")
        fs.create(path(f"{new}/{DONE}"), True).close()
    keep, held = _bases(spark, deltas)
    for b in _children(spark, deltas):
        if b in held or (b.startswith("base=") and not (keep or "").endswith(b)):
            fs.delete(path(f"{deltas.rstrip('/')}/{b}"), True)


def delta_batch(state: str, deltas: str, run: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function of ``apply_delta``, named by the stream's identity."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        apply_delta(batch, str(batch_id), state, deltas, run_identity(batch.sparkSession) if run is None else run)

    return fn


def run_marts_stream(spark: SparkSession, src: str, state: str, deltas: str, checkpoint: str,
                     max_files: int | None = None) -> StreamingQuery:
    """The landed changes below ``src`` into the state and the daily revenue deltas, micro-batch by micro-batch."""
    return (cdc_stream(spark, src, max_files).writeStream.foreachBatch(delta_batch(state, deltas))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
