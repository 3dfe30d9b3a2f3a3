"""Batch jobs beyond the reports: guarded refunds, CDC staging, quality gate."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payflow import constants as K
from payflow.operators.fold import greedy_cap
from payflow.operators.windows import latest_per_key
from payflow.sources.readers import TOPIC_PREFIX, parse_messages
from payflow.plans.bindings import Views
from payflow.plans.marts import Marts
from payflow.plans.reports_oltp import latest


# ----------------------------------------------------------------------------- J9
def refund_requests(v: Views) -> DataFrame:
    """Refund requests: returned line items ask back their net price on the order."""
    li = v.table("lineitem").filter(F.col("l_returnflag") == "R")
    return li.select(F.col("l_orderkey").alias("transaction_id"),
                     F.col("l_shipdate").alias("requested_at"), F.col("l_linenumber").alias("line"),
                     F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
                     F.round(F.col("l_extendedprice").cast("decimal(14,2)")
                             * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")), 2)
                     .cast("decimal(14,2)").alias("amount"))


def guarded_refunds(v: Views, requests: DataFrame | None = None) -> DataFrame:
    """Accept requests in time order while refunds so far + request <= payment amount.

    Only succeeded payments can be refunded; existing succeeded refunds count first.
    Output: every request with its decision (accepted rows become refund + audit rows
    via ``refund_outputs``).
    """
    req = requests if requests is not None else refund_requests(v)
    tx = v.tx.filter(F.col("status") == "succeeded").select("transaction_id", F.col("amount").alias("_tx_amount"))
    done = (v.refunds.filter(F.col("status") == "succeeded").groupBy("transaction_id")
            .agg(F.sum("amount").alias("_done")))
    j = (req.join(tx, "transaction_id").join(done, "transaction_id", "left")
         .withColumn("room", F.col("_tx_amount") - F.coalesce("_done", F.lit(Decimal("0")))))
    out = greedy_cap(j, "transaction_id", ["requested_at", "line", "part", "supplier", "amount"], "amount", "room",
                     [])
    return out.select("transaction_id", "requested_at", "line", "part", "supplier",
                      F.col("amount").cast("double").alias("amount"), "accepted",
                      F.col("accepted_total_after").cast("double").alias("accepted_total_after"))


def refund_outputs(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted decisions -> (refund rows, audit rows), written together by the caller."""
    acc = decisions.filter("accepted")
    rid = F.concat_ws("_", F.lit("re"), F.col("transaction_id").cast("string"), F.col("line").cast("string"),
                      F.col("part").cast("string"), F.col("supplier").cast("string"))
    refunds = acc.select(rid.alias("refund_id"), "transaction_id", F.col("amount").cast("decimal(14,2)").alias("amount"),
                         F.lit("requested_by_customer").alias("reason"), F.lit("succeeded").alias("status"),
                         F.col("requested_at").alias("created_at"))
    audit = refunds.select(F.concat(F.lit("aud_"), F.col("refund_id")).alias("audit_id"),
                           F.lit("INSERT").alias("event_type"), F.lit("refunds").alias("table_name"),
                           F.col("refund_id").alias("record_id"), F.lit("svc_refund_api").alias("user_id"),
                           F.lit("service").alias("user_role"), "created_at")
    return refunds, audit


# ----------------------------------------------------------------------------- CDC
AFTER_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType()), T.StructField("merchant_id", T.LongType()),
    T.StructField("customer_id", T.LongType()), T.StructField("amount", T.DecimalType(14, 2)),
    T.StructField("currency_code", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("geo_country_code", T.StringType()), T.StructField("device_type", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])
JSON_OPTS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"}
ENVELOPE = T.StructType([
    T.StructField("before", AFTER_SCHEMA), T.StructField("after", AFTER_SCHEMA),
    T.StructField("source", T.StructType([T.StructField("lsn", T.LongType())])),
    T.StructField("op", T.StringType()),
])


def cdc_messages(v: Views) -> DataFrame:
    """Change messages replayed from the payments (Debezium-style JSON envelopes).

    Per payment: create (status pending, lsn 10k+1), update to the final status
    (lsn 10k+2, missing when k % 11 = 0), delete (lsn 10k+3) when k % 50 = 7. The
    update arrives before the create when k % 9 = 0; the create is replayed twice when
    k % 13 = 0. Of the replayed creates that are due after 900 s, those with k % 17 = 3 are cut off,
    k % 19 = 4 have no operation, k % 23 = 5 no position and k % 29 = 6 no image: dead letters.
    Columns: topic, key, value (JSON), ingested_at.
    """
    t = v.tx
    k = F.col("transaction_id")
    cols = [c.name for c in AFTER_SCHEMA.fields]
    row = F.struct(*[F.col(c) for c in cols])
    pending = F.struct(*[F.lit("pending").alias(c) if c == "status" else F.col(c) for c in cols])
    base = F.col("created_at")
    ev = F.array(
        F.struct(F.lit("c").alias("op"), (k * 10 + 1).alias("lsn"), F.lit(None).cast(AFTER_SCHEMA).alias("before"),
                 pending.alias("after"), F.timestamp_add("SECOND", F.when(k % 9 == 0, 120).otherwise(60), base)
                 .alias("ingested_at")),
        F.when(k % 13 == 0, F.struct(F.lit("c").alias("op"), (k * 10 + 1).alias("lsn"),
                                     F.lit(None).cast(AFTER_SCHEMA).alias("before"), pending.alias("after"),
                                     F.timestamp_add("SECOND", F.lit(600), base).alias("ingested_at"))),
        F.when(k % 11 != 0, F.struct(F.lit("u").alias("op"), (k * 10 + 2).alias("lsn"), pending.alias("before"),
                                     row.alias("after"), F.timestamp_add("SECOND", F.when(k % 9 == 0, 30)
                                                                         .otherwise(90), base).alias("ingested_at"))),
        F.when(k % 50 == 7, F.struct(F.lit("d").alias("op"), (k * 10 + 3).alias("lsn"), row.alias("before"),
                                     F.lit(None).cast(AFTER_SCHEMA).alias("after"),
                                     F.timestamp_add("SECOND", F.lit(300), base).alias("ingested_at"))),
    )
    e = t.select(k.alias("k"), F.explode(ev).alias("e")).filter(F.col("e").isNotNull()).select("k", "e.*")
    value = F.to_json(F.struct("before", "after", F.struct(F.col("lsn")).alias("source"), "op"), JSON_OPTS)
    topic = F.lit(f"{TOPIC_PREFIX}.public.transactions").alias("topic")
    good = e.select(topic, F.col("k").cast("string").alias("key"), value.alias("value"), "ingested_at")
    image, source = F.struct(pending.alias("after")), F.struct(F.struct((k * 10 + 1).alias("lsn")).alias("source"))
    broken = (F.when(k % 17 == 3, F.substring(F.to_json(image, JSON_OPTS), 1, 40))
              .when(k % 19 == 4, F.to_json(F.struct(image["after"].alias("after"), source["source"].alias("source")), JSON_OPTS))
              .when(k % 23 == 5, F.to_json(F.struct(image["after"].alias("after"), F.lit("c").alias("op")), JSON_OPTS))
              .when(k % 29 == 6, F.to_json(F.struct(source["source"].alias("source"), F.lit("c").alias("op")), JSON_OPTS)))
    bad = t.select(topic, k.cast("string").alias("key"), broken.alias("value"),
                   F.timestamp_add("SECOND", F.lit(900), base).alias("ingested_at")).filter(F.col("value").isNotNull())
    return good.unionByName(bad)


def usable_changes(parsed: DataFrame) -> DataFrame:
    """Typed rows (id, after.*, lsn, op) of the usable messages among ``readers.parse_messages``' rows."""
    img = F.coalesce(F.col("_env.after"), F.col("_env.before"))
    return parsed.filter(F.col("_cause").isNull()).select(
        *[img[f.name].alias(f.name) for f in AFTER_SCHEMA.fields],
        F.col("_env.source.lsn").alias("lsn"), F.col("_env.op").alias("op"), "ingested_at")


def parse_cdc(msgs: DataFrame) -> DataFrame:
    """A4 / K1: envelope -> typed rows (id, after.*, lsn, op); the other messages are
    ``readers.dead_letters``."""
    return usable_changes(parse_messages(msgs, ENVELOPE, options=JSON_OPTS))


def stage_transactions(rows: DataFrame, ignore_deletes: bool = False) -> DataFrame:
    """Latest image per payment by highest LSN; a payment whose latest change is a
    delete is dropped (``ignore_deletes=True`` filters deletes before ranking instead,
    which lets a deleted payment survive through its older image)."""
    if ignore_deletes:
        rows = rows.filter(F.col("op") != "d")
    last = latest_per_key(rows.drop("ingested_at"), ["transaction_id"], [F.col("lsn")])
    return last.filter(F.col("op") != "d")


def staged(v: Views, msgs: DataFrame | None = None) -> DataFrame:
    """The staged payments of the landed messages ``msgs``."""
    s = stage_transactions(parse_cdc(msgs if msgs is not None else cdc_messages(v)))
    return s.select(*[c.name for c in AFTER_SCHEMA.fields if c.name != "amount"],
                    F.col("amount").cast("double").alias("amount"), "lsn", "op")


def dead_letter_report(msgs: DataFrame) -> DataFrame:
    """Every message is usable or dead: messages by topic and cause (null for the usable ones),
    their number of distinct keys and their span of arrival."""
    parsed = parse_messages(msgs, ENVELOPE, options=JSON_OPTS)
    return (parsed.groupBy("topic", F.col("_cause").alias("error"))
            .agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("key").alias("keys"),
                 F.min("ingested_at").alias("first_at"), F.max("ingested_at").alias("last_at")))


# ----------------------------------------------------------------------------- quality (L)
def quality_report(m: Marts, feats: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """Blocking checks as one table (check_name, ok, observed). Every check is a partial
    aggregate or an anti join; the report has one row per check."""
    v = m.v
    tx, fact = v.tx, m.fact_transactions
    lo, hi = K.FRAUD_RATE_BOUNDS

    def stats(df: DataFrame, **cols: Column) -> dict[str, Column]:
        """One pass per table: all its measures as one struct-valued scalar subquery."""
        s = df.agg(F.struct(*[c.alias(k) for k, c in cols.items()])).scalar()
        return {k: s[k] for k in cols}

    failed = F.col("status") == "failed"
    n = F.count(F.lit(1))
    vals = {}
    vals.update(stats(tx, n=n,
                      failed_no_reason=F.count_if(failed & F.col("failure_reason").isNull()),
                      bad_status=F.count_if(~F.col("status").isin("succeeded", "failed")),
                      non_positive_amount=F.count_if(F.col("amount") <= 0),
                      reason_rule=F.count_if(failed != F.col("failure_reason").isNotNull())))
    vals.update(stats(v.fraud_indicators, hc=F.count_if(F.col("risk_level").isin("high", "critical"))))
    vals.update(stats(v.fraud_indicators.join(tx, "transaction_id", "left_anti"), orphans=n))
    vals.update(stats(fact, n_fact=n, dup_ids=n - F.countDistinct("transaction_id"),
                      neg_usd=F.count_if(F.col("amount_usd") < 0),
                      bad_risk=F.count_if(F.col("risk_level").isNotNull()
                                          & ~F.col("risk_level").isin("low", "medium", "high", "critical")),
                      null_keys=F.count_if(F.col("merchant_sk").isNull() | F.col("customer_sk").isNull()),
                      last_load=F.max("loaded_at")))
    vals.update(stats(fact.join(m.dim_merchant, "merchant_sk", "left_anti"), fk_merchant=n))
    vals.update(stats(m.dim_customer, pii=F.count_if(F.col("email_hash").like("%@%"))))
    vals.update(stats(m.dim_merchant.filter("is_current").groupBy("merchant_id").count().filter("count > 1"),
                      multi_current=n))
    nxt = F.lead("scd_start").over(Window.partitionBy("merchant_id").orderBy("scd_start"))
    vals.update(stats(m.dim_merchant.withColumn("_next", nxt)
                      .filter(F.col("_next").isNotNull() & (F.coalesce(F.col("scd_end"), F.lit("9999-12-31").cast("date"))
                                                            > F.col("_next"))), overlaps=n))
    vals.update(stats(v.disputes, dispute_rule=F.count_if(F.col("status").isin("won", "lost")
                                                          != F.col("resolved_at").isNotNull())))
    vals.update(stats(v.disputes, dispute_status=F.count_if(~F.col("status").isin(*K.DISPUTE_STATUSES))))
    vals.update(stats(v.subscriptions,
                      period_rule=F.count_if(~(F.col("current_period_end") > F.col("current_period_start"))),
                      subscription_status=F.count_if(~F.col("status").isin("active", "past_due", "canceled"))))
    vals.update(stats(v.fx.groupBy("rate_date", "currency_code").agg(n.alias("_n")), dup_rates=F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))))
    vals.update(stats(v.refunds.join(tx, "transaction_id", "left_anti"), fk_refund=n))
    vals.update(stats(v.disputes.join(tx, "transaction_id", "left_anti"), fk_dispute=n))
    vals.update(stats(tx.join(v.customers, "customer_id", "left_anti"), fk_customer=n))
    vals.update(stats(fact.join(m.dim_customer, "customer_sk", "left_anti"), fk_dim_customer=n))
    actions = [a for _, _, a in K.RISK_THRESHOLDS] + [K.RISK_TOP[1]]
    vals.update(stats(v.refunds.select("transaction_id", F.col("amount").alias("_r"), F.col("status").alias("_s"))
                      .join(tx.select("transaction_id", F.col("amount").alias("_t")), "transaction_id", "left"),
                      refund_amount=F.count_if(F.col("_t").isNotNull() & ~((F.col("_r") > 0) & (F.col("_r") <= F.col("_t")))),
                      refund_status=F.count_if(~F.col("_s").isin("pending", "succeeded", "failed"))))
    vals.update(stats(v.fx, fx_rate=F.count_if(~(F.col("rate_to_usd") > 0))))
    vals.update(stats(v.fraud_indicators, score_range=F.count_if(~F.col("anomaly_score").between(0, 1)),
                      action=F.count_if(~F.col("action_taken").isin(*actions))))
    vals.update(stats(v.payment_methods, instrument=F.count_if(~F.col("type").isin(*K.PAYMENT_TYPES))))
    vals.update(stats(v.products, interval=F.count_if(F.col("billing_interval").isNotNull()
                                                      & ~F.col("billing_interval").isin("month", "year"))))
    for parent, own, name in ((v.products, "product_id", "fk_product"), (v.payment_methods, "payment_method_id", "fk_instrument"),
                              (v.countries.withColumnRenamed("country_code", "geo_country_code"), "geo_country_code", "fk_geography"),
                              (v.currencies, "currency_code", "fk_currency")):
        orphans = tx.filter(F.col(own).isNotNull()).join(parent.select(own), own, "left_anti")
        vals.update(stats(orphans, **{name: n}))
    vals.update(stats(v.logs, bad_dates=F.count_if(F.col("timestamp").isNull())))
    if feats is not None:
        vals.update(stats(feats, n_feat=n))
    as_of = as_of if as_of is not None else v.tx_as_of
    row = v.spark.range(1).select(*[c.alias(k) for k, c in vals.items()])
    checks = [
        ("oltp_transactions_not_empty", F.col("n") > 0, F.col("n")),
        ("oltp_no_orphan_fraud_indicator", F.col("orphans") == 0, F.col("orphans")),
        ("oltp_failed_have_reason", F.col("failed_no_reason") == 0, F.col("failed_no_reason")),
        ("oltp_fraud_rate_in_bounds", (F.col("hc") / F.col("n")).between(lo, hi), F.round(F.col("hc") / F.col("n"), 6)),
        ("oltp_status_accepted_values", F.col("bad_status") == 0, F.col("bad_status")),
        ("oltp_amount_positive", F.col("non_positive_amount") == 0, F.col("non_positive_amount")),
        ("oltp_failed_iff_reason", F.col("reason_rule") == 0, F.col("reason_rule")),
        ("oltp_dispute_resolved_iff_closed", F.col("dispute_rule") == 0, F.col("dispute_rule")),
        *[(name, F.col(c) == 0, F.col(c)) for name, c in (
            ("oltp_subscription_period_forward", "period_rule"), ("oltp_subscription_status_accepted_values", "subscription_status"),
            ("oltp_dispute_status_accepted_values", "dispute_status"), ("oltp_fx_day_currency_unique", "dup_rates"),
            ("oltp_refund_fk", "fk_refund"), ("oltp_dispute_fk", "fk_dispute"), ("oltp_transaction_customer_fk", "fk_customer"),
            ("oltp_refund_amount_in_bounds", "refund_amount"), ("oltp_refund_status_accepted_values", "refund_status"),
            ("oltp_fx_rate_positive", "fx_rate"), ("oltp_score_in_unit_range", "score_range"),
            ("oltp_action_accepted_values", "action"), ("oltp_instrument_type_accepted_values", "instrument"),
            ("oltp_billing_interval_accepted_values", "interval"), ("oltp_transaction_product_fk", "fk_product"),
            ("oltp_transaction_instrument_fk", "fk_instrument"), ("oltp_transaction_geography_fk", "fk_geography"),
            ("oltp_transaction_currency_fk", "fk_currency"), ("olap_fact_customer_fk", "fk_dim_customer"))],
        ("olap_fact_matches_oltp", F.col("n_fact") == F.col("n"), F.col("n_fact") - F.col("n")),
        ("olap_fact_unique_transaction_id", F.col("dup_ids") == 0, F.col("dup_ids")),
        ("olap_amount_usd_non_negative", F.col("neg_usd") == 0, F.col("neg_usd")),
        ("olap_risk_level_accepted_values", F.col("bad_risk") == 0, F.col("bad_risk")),
        ("olap_fact_keys_not_null", F.col("null_keys") == 0, F.col("null_keys")),
        ("olap_fact_merchant_fk", F.col("fk_merchant") == 0, F.col("fk_merchant")),
        ("olap_no_pii_email", F.col("pii") == 0, F.col("pii")),
        ("olap_scd2_single_current_version", F.col("multi_current") == 0, F.col("multi_current")),
        ("olap_scd2_no_overlap", F.col("overlaps") == 0, F.col("overlaps")),
        ("olap_fact_recency_15min",
         (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("last_load").cast("timestamp"))) <= 900,
         (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("last_load").cast("timestamp")))),
        ("nosql_logs_are_dates", F.col("bad_dates") == 0, F.col("bad_dates")),
    ]
    if feats is not None:
        checks.append(("nosql_ml_features_matches_oltp", F.col("n_feat") == F.col("n"), F.col("n_feat") - F.col("n")))
    arr = F.array(*[F.struct(F.lit(name).alias("check_name"), ok.alias("ok"), obs.cast("double").alias("observed"))
                    for name, ok, obs in checks])
    return row.select(F.inline(arr))


def failed_checks(report: DataFrame) -> DataFrame:
    return report.filter(~F.col("ok"))


def volume_anomalies_daily(tx: DataFrame, tolerance: float = 0.30) -> DataFrame:
    """Daily row count vs the same weekday one week before; flag |change| > tolerance.

    One row per day: the window runs over days (bounded by the calendar), not rows."""
    d = tx.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    prev = d.select(F.date_add("day", 7).alias("day"), F.col("n").alias("n_prev_week"))
    j = d.join(prev, "day", "left")
    change = (F.col("n") - F.col("n_prev_week")).cast("double") / F.col("n_prev_week")
    return j.select("day", "n", "n_prev_week", F.round(change, 4).alias("change"),
                    F.coalesce(F.abs(change) > tolerance, F.lit(False)).alias("anomaly"))
