"""Scalar Column expressions (H-series) on hand-picked values, including boundaries."""

import datetime as dt
import hashlib
from decimal import Decimal

from pyspark.sql import functions as F

from payflow import functions as PF


def test_money_and_calendar(spark):
    df = spark.createDataFrame([(Decimal("1234.50"), 0, dt.datetime(2024, 3, 7, 5, 6, 7), 202403, 202312)],
                               "a decimal(14,2), dec int, ts timestamp_ntz, ym int, ym0 int")
    r = df.select(PF.round_for_currency(F.col("a"), F.col("dec")).alias("jpy"), PF.date_sk(F.col("ts")).alias("sk"),
                  PF.year_month_of_sk(PF.date_sk(F.col("ts"))).alias("ym_txt"),
                  PF.months_between_ym(F.col("ym"), F.col("ym0")).alias("dm"),
                  PF.pct(F.lit(1), F.lit(8)).alias("p"), PF.pct(F.lit(1), F.lit(0)).alias("p0"),
                  PF.safe_ratio(F.lit(3), F.lit(0)).alias("r0")).collect()[0]
    assert r.jpy == Decimal("1235.00")                    # half away from zero
    assert r.sk == 20240307 and r.ym_txt == "2024-03" and r.dm == 3
    assert r.p == 12.5 and r.p0 is None and r.r0 is None


def test_hashing_ip_and_email(spark):
    df = spark.createDataFrame([("a@b.c", "81.2.69.160", "u1")], "email string, ip string, u string")
    r = df.select(PF.salted_sha256(F.col("email")).alias("h"), PF.ip_to_24(F.col("ip")).alias("ip24"),
                  PF.looks_like_email(F.col("email")).alias("e"), PF.short_sha256(F.col("u")).alias("s"),
                  PF.surrogate_md5(F.col("u"), F.lit(None)).alias("m")).collect()[0]
    assert r.h == hashlib.sha256(("demo-salt-rotate-in-prod" + "a@b.c").encode()).hexdigest()
    assert r.ip24 == "81.2.69.0" and r.e and r.s == hashlib.sha256(b"u1").hexdigest()[:16]
    assert r.m == hashlib.md5(b"u1-_null_").hexdigest()


def test_risk_levels_at_thresholds(spark):
    vals = [0.0, 0.2999, 0.30, 0.5999, 0.60, 0.8499, 0.85, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [(r.l, r.a) for r in df.select(PF.risk_level(F.col("p")).alias("l"), PF.risk_action(F.col("p")).alias("a"))
           .collect()]
    assert got == [("low", "allow"), ("low", "allow"), ("medium", "challenge_3ds"), ("medium", "challenge_3ds"),
                   ("high", "review"), ("high", "review"), ("critical", "block"), ("critical", "block")]
    s = spark.range(1).select(PF.sigmoid(F.lit(0.0)).alias("s")).collect()[0].s
    assert s == 0.5


def test_shuffle_width_comes_from_cluster_cores_not_driver(spark):
    from payflow.session import get_spark
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        s = get_spark()                                   # no explicit count, none submitted
        assert s.conf.get("spark.sql.shuffle.partitions") == str(max(8, 3 * s.sparkContext.defaultParallelism))
        s = get_spark(shuffle_partitions=5)               # explicit count wins
        assert s.conf.get("spark.sql.shuffle.partitions") == "5"
        assert s.conf.get("spark.sql.session.timeZone") == "UTC"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
