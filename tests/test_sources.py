"""Readers and sinks on small files written to a scratch folder."""

import datetime as dt
import json
import os
import shutil
from decimal import Decimal

from pyspark.sql import functions as F

from payflow.operators.windows import latest_per_key
from payflow.plans.jobs import ENVELOPE
from payflow.plans.reports_oltp import failed_last
from payflow.sources import readers as R
from payflow.sources import sinks as S


def test_read_oltp_csv_typed(spark, tmp):
    with open(os.path.join(tmp, "refunds.csv"), "w") as f:
        f.write("refund_id,transaction_id,amount,reason,status,created_at\n")
        f.write("re_1,ch_1,12.50,requested_by_customer,succeeded,2024-01-02T10:00:00Z\n")
    df = R.read_oltp(spark, tmp, "refunds")
    r = df.collect()[0]
    assert r.amount == Decimal("12.50") and str(df.schema["amount"].dataType) == "DecimalType(14,2)"
    assert r.created_at == dt.datetime(2024, 1, 2, 10, 0)


def test_read_documents_extended_json_dates(spark, tmp):
    docs = [{"_id": "rec_1", "merchant_id": "mer_1", "valid_until": {"$date": "2024-02-01T00:00:00Z"},
             "recommendations": [{"segment": "high_value", "suggested_method": "card", "confidence": 0.9}]}]
    p = os.path.join(tmp, "rec.json")
    with open(p, "w") as f:
        json.dump(docs, f, indent=1)
    schema = ("_id string, merchant_id string, valid_until struct<`$date`: string>, "
              "recommendations array<struct<segment: string, suggested_method: string, confidence: double>>")
    df = R.read_documents(spark, p, schema, ["valid_until"])
    r = df.collect()[0]
    assert r.valid_until == dt.datetime(2024, 2, 1) and r.recommendations[0].confidence == 0.9


def test_route_exclude_and_dlq(spark):
    good = json.dumps({"before": None, "after": {"transaction_id": 1, "status": "succeeded"},
                       "source": {"lsn": 11}, "op": "c"})
    msgs = spark.createDataFrame([("pay.public.transactions", "1", good, None),
                                  ("pay.public.transactions", "2", "{not json", None),
                                  ("pay.public.refunds", "3", json.dumps({"after": {}}), None)],
                                 "topic string, key string, value string, ingested_at timestamp_ntz")
    ok, dlq = R.split_dlq(R.route_topic(msgs), ENVELOPE)
    assert ok.count() == 1 and dlq.count() == 2
    assert {r.topic for r in dlq.collect()} == {"pay.transactions", "pay.refunds"}
    assert "value" not in R.exclude_columns(msgs, ["value"]).columns


def test_load_fx_inverts_usd_base(spark):
    p = spark.createDataFrame([('{"base": "USD", "date": "2024-01-01", "rates": {"EUR": 0.8, "JPY": 150.0}}',)],
                              "payload string")
    got = {r.currency_code: r.rate_to_usd for r in R.load_fx(p).collect()}
    assert got["EUR"] == Decimal("1.25000000")


def test_xml_messages_keep_raw(spark):
    df = spark.createDataFrame([("<msg><id>7</id><amount>1.5</amount></msg>",)], "x string")
    r = R.parse_xml_messages(df, "x", "id long, amount double").collect()[0]
    assert r.id == 7 and r.amount == 1.5 and r.raw_xml.startswith("<msg>")


def test_evidence_metadata_hashes(spark, tmp):
    p = os.path.join(tmp, "ev")
    os.makedirs(p)
    with open(os.path.join(p, "a.pdf"), "wb") as f:
        f.write(b"hello")
    r = R.evidence_metadata(spark, p).collect()[0]
    assert r.size_bytes == 5 and r.content_type == "application/pdf"
    assert r.sha256 == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"


def test_change_log_state(spark, tmp):
    base, order = os.path.join(tmp, "state"), [F.col("lsn")]
    schema = "id long, lsn long, v string, d boolean"
    state = lambda: sorted((r.id, r.v) for r in S.read_state(spark, base, ["id"], order, "d").collect())
    assert S.read_state(spark, base, ["id"], order, "d") is None
    S.upsert(spark, base, spark.createDataFrame([(1, 11, "a", False), (2, 21, "b", False)], schema), ["id"], order, 0)
    b2 = spark.createDataFrame([(1, 12, "a2", False), (2, 23, None, True), (1, 10, "old", False)], schema)
    S.upsert(spark, base, b2, ["id"], order, 1)
    rows = S.read_log(spark, base).count()
    assert state() == [(1, "a2")]
    S.upsert(spark, base, b2, ["id"], order, 1)                         # replay of the batch: nothing is added
    assert state() == [(1, "a2")] and S.read_log(spark, base).count() == rows
    S.upsert(spark, base, spark.createDataFrame([(2, 22, "late", False)], schema), ["id"], order, 2)
    assert state() == [(1, "a2")]                                       # an older change after the delete
    S.compact_state(spark, base, ["id"], order)
    assert state() == [(1, "a2")] and S.read_log(spark, base).count() == 2
    S.upsert(spark, base, spark.createDataFrame([(2, 22, "late", False, 1)], schema + ", extra int"), ["id"], order, 3)
    assert state() == [(1, "a2")]                                       # the tombstone outlives compaction, columns may come
    # a write that stopped half-way leaves only files that no reader takes
    os.makedirs(os.path.join(base, "_temporary", "0"))
    assert state() == [(1, "a2")]


def _log_rows(n, seed):
    import random
    r = random.Random(seed)
    return [(r.randrange(40), n * 100 + i, f"v{n}.{i}", r.random() < 0.2) for i in range(12)]


def _latest(batches):
    last = {}
    for k, lsn, v, d in sorted((row for b in batches for row in b), key=lambda x: x[1]):
        last[k] = (v, d)
    return sorted((k, v) for k, (v, d) in last.items() if not d)


def test_levels_keep_reads_short_and_tombstones(spark, tmp):
    base, order, schema = os.path.join(tmp, "log"), [F.col("lsn")], "id long, lsn long, v string, d boolean"
    batches, n = [], 22
    for i in range(n):
        batches.append(_log_rows(n - i, i))                             # older and older changes arrive
        S.upsert(spark, base, spark.createDataFrame(batches[-1], schema), ["id"], order, i, buckets=3, fan=3)
        runs = S.log_runs(spark, base)
        assert all(len(r) < 3 for r in runs.values()) and sum(map(len, runs.values())) <= 2 * (len(runs) + 1)
    assert max(runs) == 2                                                # 3 levels hold 22 batches
    got = sorted((r.id, r.v) for r in S.read_state(spark, base, ["id"], order, "d").collect())
    assert got == _latest(batches)
    S.compact_state(spark, base, ["id"], order)
    S.compact_levels(spark, base, ["id"], order)                        # takes the marked runs away
    assert sum(map(len, S.log_runs(spark, base).values())) == 1 and not S.log_runs(spark, base, retired=True)
    assert sorted((r.id, r.v) for r in S.read_state(spark, base, ["id"], order, "d").collect()) == _latest(batches)


def test_crash_at_any_step_of_a_merge(spark, tmp, monkeypatch):
    order, schema = [F.col("lsn")], "id long, lsn long, v string, d boolean"
    state = lambda base: sorted((r.id, r.v) for r in S.read_state(spark, base, ["id"], order, "d").collect())

    def filled(name):
        base, batches = os.path.join(tmp, name), [_log_rows(i, 50 + i) for i in range(3)]
        for i, b in enumerate(batches):
            S.upsert(spark, base, spark.createDataFrame(b, schema), ["id"], order, i, buckets=3, fan=None)
        return base, _latest(batches)

    # the merged run is only half there: some of its buckets, no input marked
    base, wanted = filled("half")
    merged = S.compact_levels(spark, base, ["id"], order, 3, 3)[0]
    for r in S.log_runs(spark, base, retired=True)[0]:
        os.remove(os.path.join(r.removeprefix("file:"), S.RETIRED))
    shutil.rmtree(os.path.join(merged, "bucket=1"))
    assert state(base) == wanted
    S.compact_levels(spark, base, ["id"], order, 3, 3)                  # runs again, under the same name
    assert state(base) == wanted and sum(map(len, S.log_runs(spark, base).values())) == 1
    # the merged run is complete, only some inputs are marked; another batch comes before the next merge
    base, wanted = filled("marks")
    S.compact_levels(spark, base, ["id"], order, 3, 3)
    os.remove(os.path.join(S.log_runs(spark, base, retired=True)[0][0].removeprefix("file:"), S.RETIRED))
    assert state(base) == wanted
    S.upsert(spark, base, spark.createDataFrame([(1, 9999, "new", False)], schema), ["id"], order, 3, buckets=3, fan=2)
    assert dict(state(base))[1] == "new" and {k: v for k, v in state(base) if k != 1} == {k: v for k, v in wanted if k != 1}


def test_merge_keeps_rows_when_columns_differ(spark, tmp):
    path = os.path.join(tmp, "m")
    old = spark.createDataFrame([(1, "a", "2024-01"), (2, "b", "2024-01"), (3, "c", "2024-02")], "id long, v string, year_month string")
    S.merge_partitions(spark, path, old, ["id"], [F.col("v")])
    new = spark.createDataFrame([("2024-01", 2, "z", 5)], "year_month string, id long, v string, extra int")
    for _ in range(2):
        S.merge_partitions(spark, path, new, ["id"], [F.col("v")])
        got = sorted((r.id, r.v) for r in spark.read.parquet(path).collect())
        assert got == [(1, "a"), (2, "z"), (3, "c")]
    import pytest
    with open(os.path.join(path, "year_month=2024-01", "broken.parquet"), "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        S.merge_partitions(spark, path, new, ["id"], [F.col("v")])
    os.remove(os.path.join(path, "year_month=2024-01", "broken.parquet"))
    assert spark.read.parquet(path).count() == 3                        # the failed merge wrote nothing


def test_partitioned_transactions_prune_and_merge(spark, tmp):
    path = os.path.join(tmp, "tx")
    rows = [(i, "failed" if i % 3 == 0 else "succeeded", "x", 1, dt.datetime(2024, 1 + i % 6, 1 + i % 27)) for i in range(60)]
    df = spark.createDataFrame(rows, "transaction_id long, status string, failure_reason string, merchant_id long, "
                                     "created_at timestamp_ntz")
    S.write_transactions(df, path)
    t = spark.read.parquet(path)
    q = failed_last(t, 30, F.lit(dt.datetime(2024, 6, 28)).cast("timestamp_ntz"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in plan and "year_month" in plan
    exp = [r for r in rows if r[1] == "failed" and r[4] >= dt.datetime(2024, 5, 29)]
    assert q.count() == len(exp)
    batch = S.with_year_month(spark.createDataFrame([(0, "succeeded", None, 1, dt.datetime(2024, 1, 1))],
                                                    df.schema))
    S.merge_partitions(spark, path, batch, ["transaction_id"], [F.col("status")])
    S.merge_partitions(spark, path, batch, ["transaction_id"], [F.col("status")])     # replay-safe
    t2 = spark.read.parquet(path)
    assert t2.count() == 60 and t2.filter("transaction_id = 0").count() == 1


def test_archive_compact_and_run_archive(spark, tmp):
    path, arch = os.path.join(tmp, "tx"), os.path.join(tmp, "cold")
    rows = [(i, dt.datetime(2024, 1 + i % 4, 2)) for i in range(40)]
    S.write_transactions(spark.createDataFrame(rows, "transaction_id long, created_at timestamp_ntz"), path)
    months = S.archive_months(spark, path, arch, "2024-03")
    assert months == ["2024-01", "2024-02"]
    assert spark.read.parquet(path).count() == 20 and spark.read.parquet(arch).count() == 20
    raw = os.path.join(tmp, "raw")
    r = spark.createDataFrame([(i, "2024-01-01", f"{i % 24:02d}") for i in range(100)], "id long, dt string, hh string")
    r.write.partitionBy("dt", "hh").parquet(raw)
    assert S.compact(spark, raw, "2024-01-01", os.path.join(tmp, "daily"), target_rows_per_file=60) == 2
    assert spark.read.parquet(os.path.join(tmp, "daily")).count() == 100
    S.archive_run(spark.range(3), os.path.join(tmp, "runs"), "2024-01-01")
    S.archive_run(spark.range(3), os.path.join(tmp, "runs"), "2024-01-01")
    assert spark.read.parquet(os.path.join(tmp, "runs")).count() == 3


def test_read_star_parquet_and_csv(spark, tmp):
    spark.range(3).withColumnRenamed("id", "date_sk").write.parquet(os.path.join(tmp, "dim_date"))
    assert R.read_star(spark, tmp, "dim_date").count() == 3
    with open(os.path.join(tmp, "dim_currency.csv"), "w") as f:
        f.write("currency_sk,currency_code\n1,USD\n")
    r = R.read_star(spark, tmp, "dim_currency", "currency_sk int, currency_code string").collect()[0]
    assert r.currency_sk == 1 and r.currency_code == "USD"
