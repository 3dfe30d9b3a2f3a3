"""Streaming jobs: CDC -> staged state table, exactly-once effect, alert fan-out, windowed
detectors, orphan holding, raw landing, micro-batch marts.

Sources are file streams here (JSON lines / Parquet); with a Kafka source only the
``readStream`` line changes. Sinks that must be replay-safe go through
``foreachBatch`` and write by batch id, so a restarted batch
rewrites the same output instead of appending duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from payflow.functions import risk_action, risk_level
from payflow.plans.jobs import ENVELOPE, JSON_OPTS, parse_cdc, usable_changes
from payflow.sources.readers import dead_letters, parse_messages
from payflow.sources.schemas import CDC_MESSAGE
from payflow.sources.sinks import read_state, upsert


def message_stream(spark: SparkSession, src: str, max_files: int | None = None) -> DataFrame:
    """Landed change messages as they are (topic, key, value, ingested_at)."""
    r = spark.readStream.schema(CDC_MESSAGE)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(src)


def cdc_stream(spark: SparkSession, src: str, max_files: int | None = None) -> DataFrame:
    """K1: landed change messages -> typed rows (same parser as the batch path)."""
    return parse_cdc(message_stream(spark, src, max_files))


def run_identity(spark: SparkSession) -> str:
    """Identity of the stream whose micro-batch runs now, kept in its checkpoint: the same after a restart,
    another one with another checkpoint. Empty outside a stream."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def batch_key(spark: SparkSession, batch_id: int, run: str | None = None) -> str:
    """Name of a micro-batch, unique over all streams that write to one target."""
    return f"{run_identity(spark) if run is None else run}-{batch_id}"


def dedupe_stream(df: DataFrame, keys: list[str], ts: str = "ingested_at", delay: str = "1 hour") -> DataFrame:
    """K2: drop replays of the same (id, lsn) within the watermark (bounded state)."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def apply_changes_batch(target: str, key: str = "transaction_id", order_col: str = "lsn", run: str | None = None
                        ) -> Callable[[DataFrame, int], None]:
    """K3: changes into the change-log state, last writer wins by LSN; deletes are tombstones.
    A micro-batch that runs again replaces its own rows; batches of other streams (a new
    checkpoint on the same target) are kept apart by the stream's identity, or by ``run``."""

    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        b = batch.withColumn("_deleted", F.col("op") == "d").drop("ingested_at")
        upsert(spark, target, b, [key], [F.col(order_col)], batch_id, run=run_identity(spark) if run is None else run)

    return fn


def land_messages_batch(target: str, dead_path: str, key: str = "transaction_id", order_col: str = "lsn",
                        run: str | None = None) -> Callable[[DataFrame, int], None]:
    """K3 + A7: raw messages of a micro-batch, parsed once: usable changes go to the state, the others
    with topic, key, raw value and cause to ``dead_path``, both under the batch's name, so a batch that runs
    again replaces both."""
    apply = apply_changes_batch(target, key, order_col, run)

    def fn(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_messages(batch, ENVELOPE, key, JSON_OPTS).persist()
        try:
            (dead_letters(parsed).write.mode("overwrite")
             .parquet(f"{dead_path.rstrip('/')}/batch={batch_key(batch.sparkSession, batch_id, run)}"))
            apply(usable_changes(parsed), batch_id)
        finally:
            parsed.unpersist()

    return fn


def upsert_predictions_batch(target: str, key: str = "transaction_id", run: str | None = None) -> Callable[[DataFrame, int], None]:
    """K4: the latest scoring of a payment wins (ordered by ``predicted_at``)."""

    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        upsert(spark, target, batch, [key], [F.col("predicted_at")], batch_id, run=run_identity(spark) if run is None else run)

    return fn


def read_changes_state(spark: SparkSession, target: str, key: str = "transaction_id", order_col: str = "lsn") -> DataFrame | None:
    """The state that ``apply_changes_batch`` keeps: latest change per key, deleted keys hidden."""
    return read_state(spark, target, [key], [F.col(order_col)], "_deleted")


def run_cdc_to_state(spark: SparkSession, src: str, target: str, checkpoint: str,
                     available_now: bool = True, dead_path: str | None = None, max_files: int | None = None) -> StreamingQuery:
    """K1 + K3 + A7: stream the landing folder into the state; messages that cannot be used land in
    ``dead_path`` (default: ``<target>-dead``). Replays need no watermark here (K2,
    ``dedupe_stream``, is for append-only sinks): the state keeps one row per key, whatever
    arrives again or late. ``availableNow`` processes everything present and stops (backfill /
    scheduled runs); otherwise a processing-time trigger keeps it running."""
    s = message_stream(spark, src, max_files)
    land = land_messages_batch(target, dead_path or f"{target.rstrip('/')}-dead")
    w = s.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def score_stream(df: DataFrame, prob_col: str = "fraud_probability") -> DataFrame:
    """K7: risk level and action as expressions on each event."""
    p = F.col(prob_col)
    return df.withColumn("risk_level", risk_level(p)).withColumn("action_taken", risk_action(p))


def route_scores_batch(alerts_path: str, indicators_path: str, run: str | None = None) -> Callable[[DataFrame, int], None]:
    """One micro-batch writes both outputs under its batch id: critical rows to
    alerts, medium-and-above to fraud indicators. A replayed batch overwrites its own
    ``batch_id`` partition in both, so the pair is never half-written twice; the partition's name
    holds the stream's identity (or ``run``), so another stream's batches are never overwritten."""

    def fn(batch: DataFrame, batch_id: int) -> None:
        b = batch.withColumn("batch_id", F.lit(f"b{batch_key(batch.sparkSession, batch_id, run)}")).persist()
        try:
            for path, cond in ((indicators_path, F.col("risk_level") != "low"),
                               (alerts_path, F.col("risk_level") == "critical")):
                (b.filter(cond).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy("batch_id").parquet(path))
        finally:
            b.unpersist()

    return fn


def windowed_counts(df: DataFrame, key: str, ts: str, window: str, min_count: int,
                    delay: str = "10 minutes") -> DataFrame:
    """Events per key per tumbling window above a threshold (append mode:
    a window is emitted once the watermark passes its end)."""
    return (df.withWatermark(ts, delay).groupBy(key, F.window(ts, window).alias("w"))
            .agg(F.count(F.lit(1)).alias("events")).filter(F.col("events") > min_count)
            .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events"))


def velocity_stream(df: DataFrame, key: str = "customer_id", ts: str = "created_at",
                    delay: str = "1 hour", length: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """K6: sliding counts per customer (state bounded by the watermark): 1 h by default, 24 h
    with ``length="24 hours", slide="1 hour"``."""
    return (df.withWatermark(ts, delay).groupBy(key, F.window(ts, length, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("payments"))
            .select(key, F.col("w.end").alias("as_of"), F.lit(length).alias("look_back"), "payments"))


def hold_orphans(children: DataFrame, parents: DataFrame, key: str, child_ts: str, parent_ts: str,
                 hold: str = "1 hour") -> DataFrame:
    """K5: stream-stream left join; a child waits up to ``hold`` for its parent, then is
    emitted with a null parent (the orphan alert) instead of being dropped."""
    c = children.withWatermark(child_ts, hold).alias("c")
    p = parents.withWatermark(parent_ts, hold).alias("p")
    cond = (F.col(f"c.{key}") == F.col(f"p.{key}")) & \
        (F.col(f"p.{parent_ts}") >= F.col(f"c.{child_ts}") - F.expr(f"INTERVAL {hold}")) & \
        (F.col(f"p.{parent_ts}") <= F.col(f"c.{child_ts}") + F.expr(f"INTERVAL {hold}"))
    return c.join(p, cond, "leftOuter").select("c.*", F.col(f"p.{key}").isNull().alias("orphan"))


def land_raw(df: DataFrame, path: str, checkpoint: str, ts: str = "ingested_at",
             every: str = "60 seconds") -> StreamingQuery:
    """Raw landing in hourly folders ``dt=/hh=``, flushed by a processing-time trigger."""
    out = df.withColumn("dt", F.date_format(ts, "yyyy-MM-dd")).withColumn("hh", F.date_format(ts, "HH"))
    return (out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("dt", "hh").trigger(processingTime=every).start())


ENVELOPE_SCHEMA = ENVELOPE
