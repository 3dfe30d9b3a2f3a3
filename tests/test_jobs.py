"""Job-level invariants on sf0.001: quality gate green, erasure leaves no residue,
pre-aggregates agree, refunds never exceed the payment, entry schema is stable."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from payflow.plans import jobs as J
from payflow.plans import privacy as P
from payflow.plans.bindings import Views
from payflow.plans.registry import all_jobs
from payflow.plans.store import stored_features, stored_marts


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:4] == ["year", "month", "country_name", "payment_type"]
    assert df.count() > 0


def test_quality_gate_green(spark):
    rep = J.quality_report(stored_marts(spark, SF_SMALL), stored_features(spark, SF_SMALL))
    bad = [r.check_name for r in rep.collect() if not r.ok]
    assert bad == []


def test_preaggregates_agree(spark):
    rows = all_jobs()["preagg_equality"](spark, SF_SMALL).collect()
    assert rows and all(r.all_equal for r in rows)


def test_erasure_residue_sees_every_kept_column(spark):
    from payflow.plans.store import stored_features, stored_marts, stored_views
    v = stored_views(spark, SF_SMALL)
    stores = P.erased_stores(v, stored_features(spark, SF_SMALL), stored_marts(spark, SF_SMALL).dim_customer)
    ids = P.erasure_requests(v)
    assert ids.count() > 0
    assert {r.store: r.residue for r in P.erasure_residue(ids, stores).collect()} == dict.fromkeys(stores, 0)
    for name, (before, after, key, still) in stores.items():
        kept = {**stores, name: (before, before, key, still)}            # this store was not erased
        got = {r.store: r.residue for r in P.erasure_residue(ids, kept).collect()}
        assert got[name] > 0 and sum(got.values()) == got[name]
    before, after, key, still = stores["dim_customer"]
    half = before.withColumn("customer_id", F.lit(None).cast("long"))    # the id is gone, the email hash stayed
    assert P.erasure_residue(ids, {"dim_customer": (before, half, key, still)}).collect()[0].residue > 0


def test_cards_beside_other_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = [f"{card} 12/27", f"{card} 123", f"{card} 5500-0000-0000-0004", "4111111111111111", "41111111111111110000", "no 1234",
             "4111 1111 1111 1112", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got: dict = {}
    for r in P.find_card_numbers(df, "doc_id", "text").collect():
        got.setdefault(r.doc_id, set()).add(r.masked_pan)
    assert "411111******1111" in got[0] & got[1] & got[2] & got[3] and "550000******0004" in got[2]
    assert not {4, 5, 7, 8} & set(got)


def test_residency_and_split(spark, tmp):
    from payflow.plans.store import stored_marts
    m = stored_marts(spark, SF_SMALL)
    countries = m.v.countries
    assert all(r.misplaced == 0 for r in P.residency_check(m.dim_customer, countries).collect())
    moved = m.dim_customer.withColumn("data_region", F.lit("EU"))
    assert sum(r.misplaced for r in P.residency_check(moved, countries).collect()) > 0
    P.split_by_region(m.dim_customer, f"{tmp}/r")
    assert spark.read.parquet(f"{tmp}/r").count() == m.dim_customer.count()


def test_guarded_refunds_never_exceed(spark):
    v = Views(spark, SF_SMALL)
    d = J.guarded_refunds(v)
    tx = v.tx.select("transaction_id", F.col("amount").cast("double").alias("tx_amount"))
    over = d.filter("accepted").groupBy("transaction_id").agg(F.max("accepted_total_after").alias("t")) \
        .join(tx, "transaction_id").filter(F.col("t") > F.col("tx_amount") + 1e-9)
    assert over.count() == 0
    refunds, audit = J.refund_outputs(d)
    assert refunds.count() == audit.count() == d.filter("accepted").count()


def test_every_registered_job_has_stable_schema(spark):
    for name in ["tx_high_risk_recent", "latency_sla", "tag_rollup", "pr_curve", "stage_transactions"]:
        a = all_jobs()[name](spark, SF_SMALL)
        b = all_jobs()[name](spark, SF_SMALL)
        assert a.schema == b.schema


def test_changed_input_is_seen_in_the_same_application(spark, tmp):
    import os
    import shutil

    from payflow.plans.store import stored_views
    for name in os.listdir(SF_SMALL):
        shutil.copyfile(os.path.join(SF_SMALL, name), os.path.join(tmp, name))
    before = stored_views(spark, tmp).tx.count()
    assert stored_views(spark, tmp) is stored_views(spark, tmp)
    os.remove(os.path.join(tmp, "orders.parquet"))
    spark.read.parquet(f"{SF_SMALL}/orders.parquet").filter("o_orderkey % 2 = 0").write.parquet(os.path.join(tmp, "orders.parquet"))
    after = stored_views(spark, tmp).tx.count()
    assert 0 < after < before


def test_recommended_methods_of_large_ids_and_without_history(spark):
    from types import SimpleNamespace

    from payflow.plans import ml as ML
    a, b = 5, 5 + 2**32                                                  # one id after a cast to int
    ids = [(a, "x"), (b, "x"), (7, "x"), (8, "y"), (9, "z"), (10, "y")]
    pays = [(a, 1)] * 9 + [(b, 2)] * 5 + [(10, 3)] * 3
    v = SimpleNamespace(
        customers=spark.createDataFrame(ids, "customer_id long, market_segment string"),
        payment_methods=spark.createDataFrame([(1, "card"), (2, "wallet"), (3, "bank_transfer")], "payment_method_id long, type string"),
        tx=spark.createDataFrame([(c, m, "succeeded", 100) for c, m in pays], "customer_id long, payment_method_id long, status string, amount long"))
    rows = ML.recommend_methods(v).collect()
    got = {r.customer_id: r.methods for r in rows}
    assert len(rows) == len(ids) and set(got) == {c for c, _ in ids}
    assert (got[a][0], got[b][0], got[10][0]) == ("card", "wallet", "bank_transfer")
    assert got[7] == ["card", "wallet"] and got[8] == ["bank_transfer"]    # no payments: the segment's types
    assert got[9] == ["card", "wallet", "bank_transfer"]                   # nor has the segment any


def test_feature_retention_and_validator(spark):
    from datetime import datetime
    from types import SimpleNamespace

    from payflow.plans import enrichment as EN
    doc = "transaction_id long, customer_id long, computed_at timestamp_ntz, model_target string, features struct<x: int>, " \
          "prediction struct<fraud_probability: double, risk_level: string, model_version: string>"
    day = datetime(2024, 1, 1)
    feats = spark.createDataFrame([
        (1, 7, datetime(2021, 12, 31), "t", (1,), (0.5, "low", "v")), (2, 7, datetime(2022, 1, 1), "t", (1,), (1.5, "low", "v")),
        (3, 8, day, "t", (1,), (1.0, "odd", "v")), (4, 8, day, None, (1,), (0.0, "high", "v")), (5, 8, day, "t", (1,), (0.0, "high", None))], doc)
    v = SimpleNamespace(tx_as_of=F.lit(day).cast("timestamp_ntz"))
    (r,) = P.feature_retention(v, feats).collect()
    assert tuple(r) == ("ml_features", 5, 1, 0)
    got = {x.rule: x.violations for x in EN.feature_schema_violations(feats).collect()}
    assert got == {"ml_features.required_fields": 2, "ml_features.fraud_probability_0_1": 1, "ml_features.risk_level_enum": 1}
    for name in ("feature_retention", "feature_schema_violations"):
        assert all_jobs()[name](spark, SF_SMALL).count() in (1, 3)


def test_every_new_quality_rule_can_fail(spark):
    from decimal import Decimal

    from payflow.plans.bindings import Views
    from payflow.plans.jobs import quality_report
    from payflow.plans.store import stored_marts
    good = stored_marts(spark, SF_SMALL)
    v = Views(spark, SF_SMALL)
    names = ("oltp_refund_amount_in_bounds", "oltp_refund_status_accepted_values", "oltp_fx_rate_positive", "oltp_score_in_unit_range",
             "oltp_action_accepted_values", "oltp_instrument_type_accepted_values", "oltp_billing_interval_accepted_values",
             "oltp_transaction_product_fk", "oltp_transaction_instrument_fk", "oltp_transaction_geography_fk",
             "oltp_transaction_currency_fk")
    before = {r.check_name: r for r in quality_report(good).collect()}
    assert all(before[n].ok and before[n].observed == 0 for n in names)

    def one(df, **cols):
        """``df`` with one row more, a copy of its first with other values."""
        return df.union(df.limit(1).withColumns({k: F.lit(x).cast(df.schema[k].dataType) for k, x in cols.items()}))

    v.__dict__.update(
        refunds=one(one(good.v.refunds, amount=Decimal("999999999.00")), status="odd"), fx=one(good.v.fx, rate_to_usd=Decimal(0)),
        fraud_indicators=one(one(good.v.fraud_indicators, anomaly_score=Decimal("1.5")), action_taken="odd"),
        payment_methods=one(good.v.payment_methods, type="odd"), products=one(good.v.products, billing_interval="week"),
        tx=one(one(one(one(good.v.tx, product_id=-1), payment_method_id=-1), geo_country_code="ZZ"), currency_code="ZZZ"))
    bad = type(good)(v, good.root)
    after = {r.check_name: r for r in quality_report(bad).collect()}
    assert {n: (after[n].ok, after[n].observed) for n in names} == {n: (False, 1.0) for n in names}


def test_recency_sees_an_old_file(spark, tmp):
    import datetime as dt
    import time

    from payflow.plans.monitoring import load_recency
    from payflow.sources.readers import with_load_time
    path = os.path.join(tmp, "t")
    spark.range(10).coalesce(1).write.parquet(path)
    now = F.lit(dt.datetime.now(dt.timezone.utc))
    fresh = load_recency(with_load_time(spark.read.parquet(path)), now).first()
    assert fresh.ok and fresh.age_s < 300
    for f in os.listdir(path):
        os.utime(os.path.join(path, f), (time.time() - 7200,) * 2)
    spark.catalog.refreshByPath(path)
    old = load_recency(with_load_time(spark.read.parquet(path)), now).first()
    assert not old.ok and old.age_s >= 7100


def test_narrowest_network_of_an_address(spark):
    from payflow.operators.ranges import cidr_range, ipv4_number, narrowest_range
    nets = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.128/25", "10.1.2.200/32", "0.0.0.0/0", "10.1.2.77/24", "bad", "1.2.3.4/40", "300.1.1.1/8"]
    ips = ["10.1.2.200", "10.1.2.201", "10.1.2.3", "10.1.9.9", "10.9.9.9", "9.9.9.9", "255.255.255.255", "1.2.3", None, "1.2.3.256"]
    lo, hi = cidr_range(F.col("cidr"))
    ranges = spark.createDataFrame([(n,) for n in nets], "cidr string").select("cidr", lo.alias("lo"), hi.alias("hi"))
    points = spark.createDataFrame(list(enumerate(ips)), "id long, ip string").select("id", ipv4_number(F.col("ip")).alias("n"))
    got = {r.id: r.cidr for r in narrowest_range(points, ranges, "id", "n", ["cidr"]).collect()}
    assert got == {0: "10.1.2.200/32", 1: "10.1.2.128/25", 2: "10.1.2.0/24", 3: "10.1.0.0/16", 4: "10.0.0.0/8", 5: "0.0.0.0/0", 6: "0.0.0.0/0"}


def test_compliance_archive_keeps_each_month_and_replaces_a_rerun(spark, tmp):
    report = spark.createDataFrame([("a", 1)], "metric string, value long")
    checks = spark.createDataFrame([("c", True)], "check_name string, ok boolean")
    P.archive_compliance(report, checks, tmp, "2024-01")
    P.archive_compliance(report, checks, tmp, "2024-02")
    P.archive_compliance(report.withColumn("value", F.lit(9).cast("long")), checks, tmp, "2024-01")     # a rerun
    rows = sorted((str(r.run_date), r.value) for r in spark.read.parquet(os.path.join(tmp, "report")).collect())
    assert rows == [("2024-01", 9), ("2024-02", 1)]
    assert spark.read.parquet(os.path.join(tmp, "checks")).count() == 2


def test_landed_messages_are_compressed_in_bounded_files(spark):
    from payflow.plans import store
    files = store.landed_messages(spark, SF_SMALL).inputFiles()
    assert files and all(f.endswith(".json.gz") for f in files)


def test_fact_is_not_shuffled_by_instrument_or_whole_dimensions(spark):
    from payflow.plans.marts import Marts
    from payflow.plans.bindings import Views
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = Marts(Views(spark, SF_SMALL))
        plan = m.fact_transactions._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(payment_method_id" not in plan
        used = m._in_use(m.dim_product, "product_id")
        assert used.count() == m.v.tx.select("product_id").distinct().join(m.dim_product, "product_id").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
