"""Fraud features (point in time), reference score, risk policy, delayed labels.

Velocity and trailing features are range frames per customer, computed in one
time-bucketed pass (see ``operators.windows``) so a very active customer is split
across tasks. Per-currency statistics and shared fingerprints are partial
aggregates joined back (bounded: 9 currencies; one row per fingerprint).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payflow import constants as K
from payflow.functions import risk_action, risk_level, sigmoid
from payflow.operators.windows import COUNT, distinct_count, frame_sum, multi_range_frame_aggs, seen_before
from payflow.plans.bindings import Views
from payflow.plans.reports_oltp import latest

HOUR, DAY = 3600, 86400


def fraud_features(v: Views) -> DataFrame:
    """Eleven features per transaction. Counts, averages and first uses see only rows at or
    before it; ``amount_zscore`` alone is against the currency's offline mean and deviation over
    the whole table, which includes later rows, so it must not be read as point-in-time."""
    tx = v.tx
    stats = tx.groupBy("currency_code").agg(F.avg(F.col("amount").cast("double")).alias("_mu"),
                                            F.stddev_samp(F.col("amount").cast("double")).alias("_sd"))
    pm = v.payment_methods
    shared = (pm.filter(F.col("fingerprint").isNotNull()).groupBy("fingerprint")
              .agg(F.countDistinct("customer_id").alias("_nc")).filter("_nc >= 2").select("fingerprint",
                                                                                          F.lit(True).alias("_sh")))
    card = pm.select("payment_method_id", "fingerprint").join(shared, "fingerprint", "left") \
        .select("payment_method_id", F.coalesce("_sh", F.lit(False)).alias("shared_card_fingerprint"))
    base = tx.select("transaction_id", "customer_id", "merchant_id", "payment_method_id", "amount", "currency_code",
                     "geo_country_code", "customer_country_code", "device_type", "created_at", "status")
    # before the frames: the first use per device needs none of them, and the pass over the frames runs once
    base = seen_before(base, ["customer_id", "device_type"], "created_at", "transaction_id", "device_seen_before")
    w = multi_range_frame_aggs(base, ["customer_id"], "created_at", {
        "_n1h": (HOUR, False, COUNT),
        "_n24h": (DAY, False, COUNT),
        "_n30": (30 * DAY, True, COUNT),
        "_sum30": (30 * DAY, True, frame_sum("amount")),
        "_cty30": (30 * DAY, True, distinct_count("geo_country_code")),
    }, peer_order="transaction_id")
    w = w.withColumn("transactions_last_1h", (F.col("_n1h") + F.col("_peer_rn") - 1).cast("int")) \
        .withColumn("transactions_last_24h", (F.col("_n24h") + F.col("_peer_rn") - 1).cast("int"))
    w = w.join(F.broadcast(stats), "currency_code").join(card, "payment_method_id", "left")
    z = (F.col("amount").cast("double") - F.col("_mu")) / F.col("_sd")
    return w.select(
        "transaction_id", "customer_id", "merchant_id", "created_at", "status",
        F.round(z, 3).alias("amount_zscore"),
        "transactions_last_1h", "transactions_last_24h",
        # exact: cents rounded half up with integers, then a double
        F.expr("CAST((2 * CAST(_sum30 * 100 AS DECIMAL(38,0)) + _n30) DIV (2 * _n30) AS DOUBLE) / 100").alias("avg_amount_30d"),
        F.col("_cty30").cast("int").alias("distinct_countries_30d"),
        (F.col("geo_country_code") != F.col("customer_country_code")).alias("geo_mismatch"),
        (F.hour("created_at") < 6).alias("night_transaction"),
        F.round(F.least(F.lit(1.0), F.col("transactions_last_1h") / 5.0), 3).alias("velocity_score"),
        "device_seen_before",
        F.coalesce("shared_card_fingerprint", F.lit(False)).alias("shared_card_fingerprint"),
        # supplied input (IP reputation service): a deterministic stand-in per transaction
        ((F.col("transaction_id") * 13) % 100).cast("double").__truediv__(100).alias("ip_reputation_score"))


def weighted_score(f: DataFrame) -> Column:
    """Reference weighted logit of the signals (no noise) through a sigmoid."""
    W = K.LOGIT_WEIGHTS
    b = lambda c: F.col(c).cast("double")
    logit = (F.lit(K.LOGIT_INTERCEPT) + W["geo_mismatch"] * b("geo_mismatch")
             + W["night_transaction"] * b("night_transaction")
             + W["amount_zscore_excess"] * F.greatest(F.lit(0.0), F.col("amount_zscore") - 1.5)
             + W["velocity_ge_3"] * (F.col("transactions_last_1h") >= 3).cast("double")
             + W["new_device"] * (~F.col("device_seen_before")).cast("double")
             + W["ip_reputation_score"] * F.col("ip_reputation_score")
             + W["shared_card_fingerprint"] * b("shared_card_fingerprint"))
    return F.round(sigmoid(logit), 4)


def top_factors(k: int = 3) -> Column:
    """Names and weights of the k strongest contributions (ties keep the listed order)."""
    items = []
    for idx, (feat, kind, a, b) in enumerate(K.FACTOR_RULES):
        if kind == "flag":
            val = F.when(F.col(feat), F.lit(a)).otherwise(F.lit(b))
        elif kind == "scale":
            val = F.round(F.col(feat) * a, 3)
        else:
            val = F.round(F.greatest(F.lit(0.0), F.col(feat)) * a, 3)
        items.append(F.struct((-val).alias("neg"), F.lit(idx).alias("idx"), F.lit(feat).alias("feature"),
                              val.alias("value")))
    ranked = F.slice(F.array_sort(F.array(*items)), 1, k)
    return F.transform(ranked, lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value")))


def resolve_labels(v: Views, as_of: Column | None = None, maturity_days: int = 120) -> DataFrame:
    """Delayed labels. Order: lost dispute -> fraud; won -> not fraud; analyst verdict;
    older than ``maturity_days`` and succeeded -> not fraud; else unknown."""
    tx = v.tx.select("transaction_id", "status", "created_at")
    as_of = as_of if as_of is not None else v.tx_as_of
    d = v.disputes.select("transaction_id", F.col("status").alias("_ds"), F.col("resolved_at").alias("_dr"))
    a = v.analyst_reviews.select("transaction_id", F.col("is_fraud").alias("_af"), F.col("labeled_at").alias("_al"))
    j = tx.join(d, "transaction_id", "left").join(a, "transaction_id", "left")
    mature = (F.col("created_at") <= as_of - F.expr(f"INTERVAL {maturity_days + 1} DAYS")) & \
        (F.col("status") == "succeeded")
    is_fraud = (F.when(F.col("_ds") == "lost", F.lit(True)).when(F.col("_ds") == "won", F.lit(False))
                .when(F.col("_af").isNotNull(), F.col("_af")).when(mature, F.lit(False)))
    source = (F.when(F.col("_ds") == "lost", "chargeback").when(F.col("_ds") == "won", "dispute_won")
              .when(F.col("_af").isNotNull(), "analyst_review").when(mature, "matured_no_dispute"))
    at = (F.when(F.col("_ds").isin("lost", "won"), F.col("_dr")).when(F.col("_af").isNotNull(), F.col("_al"))
          .when(mature, F.timestamp_add("DAY", F.lit(maturity_days), F.col("created_at"))))
    return j.select("transaction_id", is_fraud.alias("is_fraud"), source.alias("source"), at.alias("labeled_at"))


def ml_features(v: Views, as_of: Column | None = None) -> DataFrame:
    """Feature documents: features, prediction (model score, policy, factors), label."""
    f = fraud_features(v)
    lab = resolve_labels(v, as_of)
    score = Views.score_of(F.col("transaction_id")).cast("double")
    feats = ["amount_zscore", "transactions_last_1h", "transactions_last_24h", "avg_amount_30d",
             "distinct_countries_30d", "geo_mismatch", "night_transaction", "velocity_score",
             "device_seen_before", "shared_card_fingerprint", "ip_reputation_score"]
    return (f.join(lab, "transaction_id", "left")
            .select("transaction_id", "customer_id", "merchant_id", F.col("created_at").alias("computed_at"),
                    F.lit("fraud_detection").alias("model_target"),
                    F.struct(*feats).alias("features"),
                    F.struct(score.alias("fraud_probability"), risk_level(score).alias("risk_level"),
                             risk_action(score).alias("action_taken"), F.lit(K.MODEL_VERSION).alias("model_version"),
                             (18 + F.col("transaction_id") % 100).cast("int").alias("latency_ms"),
                             F.timestamp_add("SECOND", F.lit(1), F.col("created_at")).alias("predicted_at"),
                             top_factors(3).alias("top_shap")).alias("prediction"),
                    F.struct("is_fraud", "source", "labeled_at").alias("label")))
