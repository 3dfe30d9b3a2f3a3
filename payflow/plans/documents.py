"""Document change stream (K13): nested documents arrive as change events and are folded into the
session and feedback facts.

A change names its collection, operation, document, position (``token``) and time, and carries a nested
body: a session change pushes a few events onto the session's document, a feedback change
carries the whole document (null for a delete). Changes may arrive again and in any order.

* Sessions: pushed events are folded per session with ``transformWithState``; a timer closes the session
  ``SESSION_GAP_S`` after its last event, and closed sessions go to the change-log state by
  micro-batch, so a batch that runs again replaces itself.
* Feedback: the latest document by token wins, deletes are tombstones (the same state as for payments).
* Changes that cannot be used land as dead letters with their raw text and cause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from payflow.operators.ranks import group_row_number
from payflow.plans.bindings import Views
from payflow.sources.sinks import read_state, upsert
from payflow.streaming.jobs import run_identity
from payflow.streaming.stateful import fold_sessions, rocksdb_state

SESSION_GAP_S = 7 * 86_400             # a session is a customer's week: its events are less than a week apart
DELAY = "1 hour"
PUSHED = 3                             # events in one change

_S, _L, _I, _B, _TS, _NTZ = (T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType(),
                             T.TimestampNTZType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CHANGE = _struct(
    ns=_S, op=_S, document_id=_S, token=_L, cluster_time=_TS,
    session=_struct(customer_id=_L, device_type=_S, push=T.ArrayType(
        _struct(event_id=_L, event=_S, page=_S, element=_S, completes=_B, at=_TS))),
    feedback=_struct(customer_id=_L, merchant_id=_L, merchant_name=_S, country_code=_S, transaction_id=_L,
                     submitted_at=_NTZ, scores=_struct(overall=_I), nps_score=_I, tags=T.ArrayType(_S)))
LANDED = "value string"
JSON_OPTS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def document_changes(v: Views) -> DataFrame:
    """Changes (one JSON ``line`` each) that lead to the sessions and feedback documents of ``v``: events pushed
    three at a time, some pushes twice; feedback inserted, some of it with an older score first, some documents
    inserted and deleted again; and a heartbeat a month after the last event."""
    at = F.col("timestamp").cast("timestamp")
    pos = group_row_number(v.session_events, ["session_id"], ["timestamp", "event_id"], "pos")
    pushes = (pos.withColumn("part", ((F.col("pos") - 1) / PUSHED).cast("long"))
              .groupBy("session_id", "customer_id", "device_type", "part")
              .agg(F.array_sort(F.collect_list(F.struct("event_id", "event", "page", "element", "completes", at.alias("at")))).alias("push")))
    session = F.struct("customer_id", "device_type", "push")
    replays = F.when(F.col("part") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sessions = (pushes.withColumn("again", F.explode(replays))
                .select(F.lit("sessions").alias("ns"), F.when(F.col("part") == 0, "insert").otherwise("update").alias("op"),
                        F.col("session_id").alias("document_id"), F.col("part").alias("token"),
                        F.element_at("push", -1)["at"].alias("cluster_time"), session.alias("session")))
    fb = v.feedback
    k = F.col("feedback_id")
    body = [F.col(c) for c in fb.columns if c != "feedback_id"]
    older = [F.struct(F.lit(1).alias("overall")).alias("scores") if c == "scores" else F.col(c) for c in fb.columns if c != "feedback_id"]
    none = F.lit(None).cast(CHANGE["feedback"].dataType)
    steps = F.array(
        F.struct(F.lit("insert").alias("op"), k.alias("id"), (k * 10 + 2).alias("token"), F.struct(*body).alias("feedback")),
        F.when(k % 3 == 0, F.struct(F.lit("insert").alias("op"), k.alias("id"), (k * 10 + 1).alias("token"), F.struct(*older).alias("feedback"))),
        F.when(k % 31 == 0, F.struct(F.lit("insert").alias("op"), (-k - 1).alias("id"), (k * 10 + 3).alias("token"), F.struct(*body).alias("feedback"))),
        F.when(k % 31 == 0, F.struct(F.lit("delete").alias("op"), (-k - 1).alias("id"), (k * 10 + 4).alias("token"), none.alias("feedback"))))
    feedback = (fb.select(F.col("submitted_at").cast("timestamp").alias("cluster_time"), F.explode(steps).alias("s"))
                .filter("s IS NOT NULL")
                .select(F.lit("feedback").alias("ns"), "s.op", F.col("s.id").cast("string").alias("document_id"),
                        "s.token", "cluster_time", "s.feedback"))
    beat = (v.session_events.agg(F.max(at).alias("last"))
            .select(F.lit("heartbeat").alias("ns"), F.lit("noop").alias("op"), F.lit("-").alias("document_id"), F.lit(0).alias("token"),
                    F.timestamp_add("DAY", F.lit(30), F.col("last")).alias("cluster_time")))
    every = sessions.unionByName(feedback, allowMissingColumns=True).unionByName(beat, allowMissingColumns=True)
    return every.select(F.to_json(F.struct(*every.columns), JSON_OPTS).alias("line"))


def parse_changes(lines: DataFrame) -> DataFrame:
    """Fields of ``CHANGE`` with the raw ``line`` and ``_cause`` (null for a usable change)."""
    corrupt = "_corrupt_record"
    schema = T.StructType([*CHANGE.fields, T.StructField(corrupt, T.StringType())])
    change = F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, **JSON_OPTS})
    parsed = lines.select("line", F.explode(F.array(change)).alias("_c")).select("line", "_c.*")
    body = (F.when(F.col("ns") == "sessions", F.col("session.push").isNotNull())
            .when(F.col("ns") == "feedback", F.col("feedback").isNotNull() | (F.col("op") == "delete"))
            .otherwise(F.col("ns") == "heartbeat"))
    return parsed.withColumn("_cause", F.when(F.col("ns").isNull() & F.col("op").isNull() | F.col(corrupt).isNotNull(), "unparsable")
                             .when(F.col("document_id").isNull() | F.col("token").isNull() | F.col("cluster_time").isNull(), "no_position")
                             .when(~F.coalesce(body, F.lit(False)), "no_body")).drop(corrupt)


def session_changes(parsed: DataFrame) -> DataFrame:
    """Flat pushed events of the usable session changes; a heartbeat stays as a row of its own, which only moves the clock."""
    beat = F.array(F.struct(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("element"),
                            F.lit(False).alias("completes"), F.col("cluster_time").alias("at")))
    pushed = F.transform("session.push", lambda e: F.struct(e["event_id"].alias("event_id"), e["element"].alias("element"),
                                                            e["completes"].alias("completes"), e["at"].alias("at")))
    return (parsed.filter(F.col("_cause").isNull() & F.col("ns").isin("sessions", "heartbeat"))
            .select("document_id", F.col("session.customer_id").alias("customer_id"),
                    F.col("session.device_type").alias("device_type"),
                    F.explode(F.when(F.col("ns") == "sessions", pushed).otherwise(beat)).alias("e"))
            .select("document_id", "customer_id", "device_type", "e.event_id", "e.element", "e.completes", "e.at"))


def feedback_changes(parsed: DataFrame) -> DataFrame:
    """What the feedback stream keeps of parsed changes: its documents, and what cannot be used of any collection with
    its raw ``line``. Sessions, most of the changes, and the raw text of usable ones are left out before the rows are cached."""
    dead = F.col("_cause").isNotNull()
    return (parsed.filter(dead | (F.col("ns") == "feedback"))
            .select(F.when(dead, F.col("line")).alias("line"), "document_id", "token", "op", "feedback", "_cause"))


def run_session_stream(spark: SparkSession, src: str, target: str, checkpoint: str, max_files: int | None = None) -> StreamingQuery:
    """Closed sessions of the landed changes below ``src`` into the state at ``target``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(spark, target, batch.filter("customer_id IS NOT NULL"), ["session_id"], [F.col("session_end")], batch_id,
               run=run_identity(spark))

    reader = spark.readStream.schema(LANDED)
    lines = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).text(src).withColumnRenamed("value", "line")
    folded = fold_sessions(session_changes(parse_changes(lines)), SESSION_GAP_S, DELAY)
    with rocksdb_state(spark):
        return (folded.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())


def run_feedback_stream(spark: SparkSession, src: str, target: str, dead_path: str, checkpoint: str,
                        max_files: int | None = None) -> StreamingQuery:
    """Feedback documents into the state at ``target``; changes of any collection that cannot be used to ``dead_path``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        run = run_identity(spark)
        parsed = feedback_changes(parse_changes(batch)).persist()
        try:
            (parsed.filter(F.col("_cause").isNotNull()).select("line", F.col("_cause").alias("error"))
             .write.mode("overwrite").parquet(f"{dead_path.rstrip('/')}/batch={run}-{batch_id}"))
            docs = (parsed.filter(F.col("_cause").isNull())
                    .select("document_id", "token", (F.col("op") == "delete").alias("_deleted"), "feedback.*"))
            upsert(spark, target, docs, ["document_id"], [F.col("token")], batch_id, run=run)
        finally:
            parsed.unpersist()

    reader = spark.readStream.schema(LANDED)
    lines = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).text(src).withColumnRenamed("value", "line")
    return (lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def streamed_sessions(spark: SparkSession, target: str) -> DataFrame:
    """The sessions that the stream has closed, as ``Views.sessions`` has them."""
    state = read_state(spark, target, ["session_id"], [F.col("session_end")])
    return state.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


def streamed_feedback(spark: SparkSession, target: str) -> DataFrame:
    """The feedback documents of the stream's state, as ``Views.feedback`` has them."""
    state = read_state(spark, target, ["document_id"], [F.col("token")], "_deleted")
    return state.withColumn("feedback_id", F.col("document_id").cast("long")).drop("document_id", "token", "_deleted")
