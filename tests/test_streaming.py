"""Streaming jobs: replay of the landed CDC equals the batch staging; paired writes are replay-safe."""

import datetime as dt
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from payflow.plans.bindings import Views
from payflow.plans.jobs import cdc_messages, parse_cdc, stage_transactions
from payflow.streaming import jobs as SJ


def test_cdc_stream_into_state_equals_batch(spark, tmp):
    v = Views(spark, SF_SMALL)
    land = os.path.join(tmp, "land")
    msgs = cdc_messages(v)
    # land in several files / two arrivals to exercise several micro-batches
    msgs.filter(F.col("key").cast("long") % 2 == 0).write.json(os.path.join(land, "a"))
    msgs.filter(F.col("key").cast("long") % 2 == 1).write.json(os.path.join(land, "b"))
    q = SJ.run_cdc_to_state(spark, os.path.join(land, "*"), os.path.join(tmp, "state"), os.path.join(tmp, "ck"))
    q.awaitTermination(300)
    state = SJ.read_changes_state(spark, os.path.join(tmp, "state")).select("transaction_id", "status", "lsn")
    batch = stage_transactions(parse_cdc(msgs)).select("transaction_id", "status", "lsn")
    assert state.count() == batch.count()
    assert state.exceptAll(batch).count() == 0 and batch.exceptAll(state).count() == 0
    # rerunning over the same files with the same checkpoint processes nothing new
    q2 = SJ.run_cdc_to_state(spark, os.path.join(land, "*"), os.path.join(tmp, "state"), os.path.join(tmp, "ck"))
    q2.awaitTermination(300)
    assert SJ.read_changes_state(spark, os.path.join(tmp, "state")).count() == batch.count()


def test_route_scores_replay_safe(spark, tmp):
    rows = [(i, p) for i, p in enumerate([0.1, 0.4, 0.7, 0.9, 0.95])]
    b = SJ.score_stream(spark.createDataFrame(rows, "transaction_id long, fraud_probability double"))
    fn = SJ.route_scores_batch(os.path.join(tmp, "alerts"), os.path.join(tmp, "ind"))
    fn(b, 7)
    fn(b, 7)                       # same batch id again (restart)
    assert spark.read.parquet(os.path.join(tmp, "alerts")).count() == 2
    assert spark.read.parquet(os.path.join(tmp, "ind")).count() == 4


def test_windowed_counts_stream(spark, tmp):
    src = os.path.join(tmp, "ev")
    base = dt.datetime(2024, 1, 1)
    rows = [("1.2.3.4", base + dt.timedelta(seconds=s)) for s in range(0, 42, 6)] + \
           [("5.6.7.8", base + dt.timedelta(seconds=3)), ("9.9.9.9", base + dt.timedelta(hours=2))]
    spark.createDataFrame(rows, "ip string, ts timestamp").write.parquet(src)
    s = spark.readStream.schema("ip string, ts timestamp").parquet(src)
    q = (SJ.windowed_counts(s, "ip", "ts", "1 minute", 5).writeStream.format("memory").queryName("bursts")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.sql("select ip, events from bursts").collect()
    assert [(r.ip, r.events) for r in got] == [("1.2.3.4", 7)]


def _cdc(spark, rows):
    """Landed messages from (op, id, lsn, status) or raw text."""
    import json
    out = []
    for r in rows:
        if isinstance(r, str):
            out.append(("pay.public.transactions", None, r, None))
            continue
        op, key, lsn, status = r
        image = {"transaction_id": key, "status": status}
        value = {"before": image if op == "d" else None, "after": None if op == "d" else image, "source": {"lsn": lsn}, "op": op}
        out.append(("pay.public.transactions", str(key), json.dumps(value), dt.datetime(2024, 1, 1)))
    return spark.createDataFrame(out, "topic string, key string, value string, ingested_at timestamp_ntz")


def test_late_create_after_delete_and_bad_messages(spark, tmp):
    land, state = os.path.join(tmp, "land"), os.path.join(tmp, "state")

    def arrive(rows):
        _cdc(spark, rows).coalesce(1).write.mode("append").json(land)
        SJ.run_cdc_to_state(spark, land, state, os.path.join(tmp, "ck")).awaitTermination(300)
        return sorted((r.transaction_id, r.status) for r in SJ.read_changes_state(spark, state).collect())

    assert arrive([("c", 1, 1, "pending"), ("c", 2, 2, "pending"), "{not json", '{"op": "c"}', '{"after": {"transaction_id": 9}}']) \
        == [(1, "pending"), (2, "pending")]
    assert arrive([("d", 1, 9, None)]) == [(2, "pending")]
    assert arrive([("u", 1, 5, "succeeded"), ("u", 2, 3, "succeeded")]) == [(2, "succeeded")]    # late change: no revival


def test_latest_prediction_wins(spark, tmp):
    from payflow.sources.sinks import read_state
    fn = SJ.upsert_predictions_batch(os.path.join(tmp, "p"))
    make = lambda *rows: spark.createDataFrame(rows, "transaction_id long, score double, predicted_at int")
    fn(make((1, 0.2, 5), (1, 0.4, 7), (2, 0.1, 1)), 0)
    fn(make((1, 0.9, 6),), 1)
    fn(make((2, 0.8, 3),), 2)
    got = read_state(spark, os.path.join(tmp, "p"), ["transaction_id"], [F.col("predicted_at")])
    assert sorted((r.transaction_id, r.score) for r in got.collect()) == [(1, 0.4), (2, 0.8)]


def test_two_checkpoints_on_one_target_lose_nothing(spark, tmp):
    state = os.path.join(tmp, "state")

    def run(name, rows):
        land = os.path.join(tmp, name)
        _cdc(spark, rows).coalesce(1).write.json(land)
        SJ.run_cdc_to_state(spark, land, state, os.path.join(tmp, f"ck-{name}")).awaitTermination(300)

    run("a", [("c", i, 1, "pending") for i in range(200)])
    run("b", [("c", i, 1, "pending") for i in range(200, 400)])
    assert SJ.read_changes_state(spark, state).count() == 400
    scored = SJ.score_stream(spark.createDataFrame([(i, 0.95) for i in range(3)], "transaction_id long, fraud_probability double"))
    for run_name in ("one", "two"):
        SJ.route_scores_batch(os.path.join(tmp, "al"), os.path.join(tmp, "in"), run=run_name)(scored, 0)
    assert spark.read.parquet(os.path.join(tmp, "al")).count() == 6


def test_a_batch_that_runs_again_replaces_itself(spark, tmp):
    land, state, ck = (os.path.join(tmp, n) for n in ("land", "state", "ck"))
    _cdc(spark, [("c", 1, 1, "pending"), "{bad"]).coalesce(1).write.json(land)
    SJ.run_cdc_to_state(spark, land, state, ck).awaitTermination(300)
    for f in os.listdir(os.path.join(ck, "commits")):                  # the stream ended before it noted its commit
        os.remove(os.path.join(ck, "commits", f))
    SJ.run_cdc_to_state(spark, land, state, ck).awaitTermination(300)
    assert SJ.read_changes_state(spark, state).count() == 1
    assert spark.read.parquet(f"{state}-dead").count() == 1
    assert len(os.listdir(os.path.join(state, "level=0"))) == 1


def test_dead_letters_of_the_stream_add_up(spark, tmp):
    land, state, dead = (os.path.join(tmp, n) for n in ("land", "state", "dead"))
    good = [("c", i, 1, "pending") for i in range(20)]
    bad = ["{not json", '{"op": "c", "source": {"lsn": 3}}', '{"op": "c", "after": {"transaction_id": 9}}',
           '{"source": {"lsn": 3}, "after": {"transaction_id": 9}}', None]
    rows = _cdc(spark, good + [b for b in bad if b]).collect() + [("pay.public.transactions", "k", None, dt.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "topic string, key string, value string, ingested_at timestamp_ntz").repartition(3) \
        .write.option("ignoreNullFields", "false").json(land)
    SJ.run_cdc_to_state(spark, land, state, os.path.join(tmp, "ck"), dead_path=dead, max_files=1).awaitTermination(300)
    letters = spark.read.parquet(dead).collect()
    assert sorted(r.error for r in letters) == ["no_key", "no_operation", "no_position", "unparsable", "unparsable"]
    assert {r.value for r in letters} == set(bad) and {r.topic for r in letters} == {"pay.public.transactions"}
    assert SJ.read_changes_state(spark, state).count() + len(letters) == len(good) + len(bad)


def test_raw_landing_by_hour(spark, tmp):
    src, out = os.path.join(tmp, "in"), os.path.join(tmp, "raw")
    hours = [dt.datetime(2024, 1, 1, 5, 59), dt.datetime(2024, 1, 1, 6, 0), dt.datetime(2024, 1, 2, 6, 30), None]
    schema = "key string, ingested_at timestamp_ntz"
    spark.createDataFrame([(str(i), h) for i, h in enumerate(hours)], schema).write.parquet(src)
    q = SJ.land_raw(spark.readStream.schema(schema).parquet(src), out, os.path.join(tmp, "ck"), every="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(str(r.dt), None if r.hh is None else int(r.hh)): r.n for r in spark.read.parquet(out).groupBy("dt", "hh").agg(F.count("*").alias("n")).collect()}
    assert got == {("2024-01-01", 5): 1, ("2024-01-01", 6): 1, ("2024-01-02", 6): 1, ("None", None): 1}
    assert os.path.isdir(os.path.join(out, "dt=2024-01-01", "hh=05"))
