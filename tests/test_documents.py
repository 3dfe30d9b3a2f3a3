"""Document change streams lead to the same documents as the tables, with replays, late changes and bad lines."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from payflow.plans import documents as DC
from payflow.plans.bindings import Views


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Changes in the order of their time, in three files; then the first file again, bad lines, and the heartbeat."""
    v, src = Views(spark, SF_SMALL), str(tmp_path_factory.mktemp("docs") / "landing")
    changes = DC.parse_changes(DC.document_changes(v)).select("line", "ns", F.unix_micros("cluster_time").alias("t")).cache()
    lo, hi = changes.filter("ns = 'sessions'").agg(F.min("t"), F.max("t")).first()
    third = (hi - lo) // 3

    def write(lines):
        lines.select("line").coalesce(1).write.mode("append").text(src)

    for i in range(3):
        write(changes.filter((F.col("ns") == "sessions") & (F.col("t") >= lo + i * third) & (F.col("t") < lo + (i + 1) * third + 3 * (i == 2)))
              .union(changes.filter((F.col("ns") == "feedback") & (F.pmod(F.hash("line"), F.lit(3)) == 2 - i))))
    write(changes.filter((F.col("ns") == "sessions") & (F.col("t") < lo + third)))
    write(spark.createDataFrame([("{cut",), ('{"ns": "sessions", "op": "insert"}',), ('{"ns": "feedback", "op": "insert", "document_id": "1", '
          '"token": 1, "cluster_time": "2024-01-01T00:00:00.000000Z"}',), ('{"ns": "other", "op": "x", "document_id": "1", "token": 1, '
          '"cluster_time": "2024-01-01T00:00:00.000000Z"}',)], "line string"))
    write(changes.filter("ns = 'heartbeat'"))
    return v, src


def _same(a, b):
    b = b.select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 0


@pytest.mark.parametrize("files", [None, 1])
def test_sessions_equal_the_table(spark, tmp, landed, files):
    v, src = landed
    state = os.path.join(tmp, "s")
    DC.run_session_stream(spark, src, state, os.path.join(tmp, "ck"), files).awaitTermination(600)
    got = DC.streamed_sessions(spark, state)
    _same(v.sessions.select("session_id", "customer_id", "device_type", "session_start", "session_end", "event_count",
                            "pay_clicks", "converted", "duration_seconds"), got)
    DC.run_session_stream(spark, src, state, os.path.join(tmp, "ck"), files).awaitTermination(600)      # nothing new
    assert DC.streamed_sessions(spark, state).count() == got.count()


def test_feedback_equals_the_table_and_bad_changes_are_kept(spark, tmp, landed):
    v, src = landed
    state, dead = os.path.join(tmp, "f"), os.path.join(tmp, "dead")
    DC.run_feedback_stream(spark, src, state, dead, os.path.join(tmp, "ck"), 1).awaitTermination(600)
    _same(v.feedback, DC.streamed_feedback(spark, state))
    errors = sorted((r.error, r.line[:9]) for r in spark.read.parquet(dead).collect())
    assert [e for e, _ in errors] == ["no_body", "no_body", "no_position", "unparsable"] and errors[-1][1] == "{cut"


def test_feedback_stream_caches_only_its_documents_and_dead_lines(spark, landed):
    _, src = landed
    parsed = DC.parse_changes(spark.read.text(src).withColumnRenamed("value", "line"))
    kept = DC.feedback_changes(parsed)
    assert "session" not in kept.columns
    assert kept.filter("_cause IS NULL").count() == parsed.filter("_cause IS NULL AND ns = 'feedback'").count() > 0
    assert kept.filter("_cause IS NULL AND line IS NOT NULL").count() == 0
    assert kept.filter("line IS NOT NULL").count() == parsed.filter("_cause IS NOT NULL").count() == 4
