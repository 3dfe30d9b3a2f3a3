"""Reports over the document collections (logs, sessions, features, feedback, recommendations).

Aggregation-pipeline stages map onto DataFrame operators: ``$match`` -> filter,
``$group`` -> groupBy/agg, ``$unwind`` -> explode (drops empty arrays),
``$facet`` -> several aggregates over one input, ``$lookup`` + ``$unwind`` -> inner join
to a pre-aggregated side. ``$round`` rounds half to even (``bround``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payflow.operators.aggregates import histogram_percentile
from payflow.operators.topk import first_k_by
from payflow.plans.bindings import Views
from payflow.plans.features import ml_features
from payflow.plans.reports_oltp import latest, since


def logs_critical(v: Views, days: int = 30, k_messages: int = 2, as_of: Column | None = None) -> DataFrame:
    """Error / critical logs per service and severity, with the first two messages."""
    logs = v.logs
    as_of = as_of if as_of is not None else latest(logs, "timestamp")
    f = (logs.filter(F.col("meta.severity").isin("error", "critical") & since("timestamp", as_of, days))
         .select(F.col("meta.service").alias("service"), F.col("meta.severity").alias("severity"),
                 F.col("metadata.latency_ms").alias("latency_ms"), "message", "timestamp", "log_id"))
    g = (f.groupBy("service", "severity")
         .agg(F.count(F.lit(1)).alias("count"), F.bround(F.avg("latency_ms"), 0).alias("avg_latency_ms"),
              F.max("latency_ms").alias("max_latency_ms")))
    samples = first_k_by(f, ["service", "severity"], ["timestamp", "log_id"], "message", k_messages,
                         "sample_messages")
    return (g.join(samples, ["service", "severity"])
            .withColumn("sample_messages", F.array_join("sample_messages", " | "))
            .orderBy(F.col("count").desc(), "service", "severity"))


def suspicious_sessions(v: Views, min_events: int = 8, min_pay_clicks: int = 5, k: int = 10) -> DataFrame:
    """Unconverted sessions with many events and repeated pay clicks (bot signal)."""
    s = v.sessions
    return (s.filter(~F.col("converted") & (F.col("event_count") > min_events)
                     & (F.col("pay_clicks") >= min_pay_clicks))
            .select("session_id", "customer_id", "session_start", F.col("duration_seconds").cast("long"),
                    "event_count", "pay_clicks", F.col("device_type").alias("device"))
            .orderBy(F.col("pay_clicks").desc(), F.col("event_count").desc(), "session_id").limit(k))


def _factor_names(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda s: s["feature"]), ",")


def high_risk_explained(v: Views, k: int = 10, feats: DataFrame | None = None) -> DataFrame:
    """Latest high / critical predictions with their three strongest factors."""
    mf = feats if feats is not None else ml_features(v)
    return (mf.filter(F.col("prediction.risk_level").isin("high", "critical"))
            .orderBy(F.col("computed_at").desc(), "transaction_id").limit(k)
            .select("transaction_id", "customer_id", "computed_at",
                    F.col("prediction.fraud_probability").alias("fraud_probability"),
                    F.col("prediction.risk_level").alias("risk_level"),
                    F.col("prediction.action_taken").alias("action_taken"),
                    F.col("prediction.model_version").alias("model_version"),
                    _factor_names(F.col("prediction.top_shap")).alias("top_factors"),
                    F.col("features.geo_mismatch").alias("geo_mismatch"),
                    F.col("features.transactions_last_1h").alias("velocity_1h"),
                    F.col("features.ip_reputation_score").alias("ip_reputation"),
                    F.col("label.is_fraud").alias("label")))


def tag_rollup(v: Views, max_score: int = 2, k_tags: int = 3) -> DataFrame:
    """Negative feedback per country with its most frequent tags.

    Kept as the reference computes it: a feedback with two tags counts twice, and the
    country averages are means of per-tag means.
    """
    fb = v.feedback.filter(F.col("scores.overall") <= max_score)
    per_tag = (fb.select("feedback_id", "country_code", F.col("scores.overall").alias("overall"), "nps_score",
                         F.explode("tags").alias("tag"))
               .groupBy("country_code", "tag")
               .agg(F.count(F.lit(1)).alias("count"), F.avg("overall").alias("avg_score"),
                    F.avg("nps_score").alias("avg_nps"), F.countDistinct("feedback_id").alias("n_ids")))
    # tags per country are bounded by the tag vocabulary: the list is small
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("neg"), F.col("tag"),
                                                          F.col("count")))), 1, k_tags)
    return (per_tag.groupBy("country_code")
            .agg(F.sum("n_ids").alias("negative_feedbacks"), F.bround(F.avg("avg_score"), 2).alias("avg_score"),
                 F.bround(F.avg("avg_nps"), 1).alias("avg_nps"),
                 F.array_join(F.transform(ranked, lambda s: F.concat(s["tag"], F.lit(":"), s["count"].cast("string"))),
                              ", ").alias("top_tags"))
            .withColumnRenamed("country_code", "country")
            .orderBy(F.col("negative_feedbacks").desc(), "country"))


def latency_sla(v: Views, days: int = 7, as_of: Column | None = None) -> DataFrame:
    """p50 / p95 latency (exact, discrete) and error rate per service."""
    logs = v.logs
    as_of = as_of if as_of is not None else latest(logs, "timestamp")
    f = (logs.filter((F.col("meta.type") == "access") & since("timestamp", as_of, days)
                     & F.col("metadata.latency_ms").isNotNull())
         .select(F.col("meta.service").alias("service"), F.col("metadata.latency_ms").alias("latency_ms"),
                 F.col("metadata.http_status").alias("http_status")))
    g = (f.groupBy("service").agg(F.count(F.lit(1)).alias("requests"), F.max("latency_ms").alias("max_ms"),
                                  F.bround(F.avg(F.when(F.col("http_status") >= 500, 1).otherwise(0)) * 100, 2)
                                  .alias("error_rate_pct")))
    p50 = histogram_percentile(f, ["service"], "latency_ms", 0.5, "disc", "p50_ms")
    p95 = histogram_percentile(f, ["service"], "latency_ms", 0.95, "disc", "p95_ms")
    return g.join(p50, "service").join(p95, "service").orderBy(F.col("p95_ms").desc(), "service")


def latency_sla_approx(v: Views, days: int = 7, accuracy: int = 10000, as_of: Column | None = None) -> DataFrame:
    """p50 / p95 with the approximate (sketch-based) percentile, as the reference's
    ``$percentile: approximate`` does: constant memory per group whatever its size."""
    logs = v.logs
    as_of = as_of if as_of is not None else latest(logs, "timestamp")
    f = logs.filter((F.col("meta.type") == "access") & since("timestamp", as_of, days))
    q = F.percentile_approx("metadata.latency_ms", [0.5, 0.95], accuracy)
    return (f.groupBy(F.col("meta.service").alias("service"))
            .agg(F.count(F.lit(1)).alias("requests"), q.alias("_q"))
            .select("service", "requests", F.col("_q")[0].alias("p50_ms"), F.col("_q")[1].alias("p95_ms")))


def latency_p95_floor(v: Views) -> DataFrame:
    """Element at floor(0.95 n) of the sorted latencies per service (fallback definition)."""
    logs = v.logs.filter(F.col("meta.type") == "access").select(F.col("meta.service").alias("service"),
                                                               F.col("metadata.latency_ms").alias("latency_ms"))
    return histogram_percentile(logs, ["service"], "latency_ms", 0.95, "floor", "p95_ms")


def precision_by_risk(v: Views, feats: DataFrame | None = None) -> DataFrame:
    """Precision per predicted risk level on labeled transactions."""
    mf = feats if feats is not None else ml_features(v)
    lab = mf.filter(F.col("label.is_fraud").isNotNull())
    return (lab.groupBy(F.col("prediction.risk_level").alias("risk_level"))
            .agg(F.count(F.lit(1)).alias("labeled"),
                 F.count_if(F.col("label.is_fraud")).alias("confirmed_frauds"),
                 F.avg("prediction.fraud_probability").alias("_p"))
            .withColumn("precision_pct", F.bround(F.col("confirmed_frauds") / F.col("labeled") * 100, 1))
            .withColumn("avg_probability", F.bround("_p", 3)).drop("_p")
            .orderBy(F.col("avg_probability").desc()))


def recall_overall(v: Views, feats: DataFrame | None = None) -> DataFrame:
    """Share of confirmed frauds the model had classed high / critical (one row)."""
    mf = feats if feats is not None else ml_features(v)
    fr = mf.filter(F.col("label.is_fraud") == True)  # noqa: E712
    return (fr.agg(F.count(F.lit(1)).alias("confirmed_frauds"),
                   F.count_if(F.col("prediction.risk_level").isin("high", "critical")).alias("caught"))
            .withColumn("recall_pct", F.bround(F.col("caught") / F.col("confirmed_frauds") * 100, 1)))


def checkout_funnel(v: Views) -> DataFrame:
    """Distinct sessions reaching each page."""
    e = v.session_events.filter(F.col("event") == "page_view")
    return (e.groupBy("page").agg(F.countDistinct("session_id").alias("sessions"))
            .orderBy(F.col("sessions").desc(), "page"))


def conversion_by_device(v: Views) -> DataFrame:
    """Sessions, conversions and mean duration per device."""
    s = v.sessions
    return (s.groupBy(F.col("device_type").alias("device"))
            .agg(F.count(F.lit(1)).alias("sessions"), F.count_if("converted").alias("converted"),
                 F.avg("duration_seconds").alias("_d"))
            .withColumn("conversion_pct", F.bround(F.col("converted") / F.col("sessions") * 100, 1))
            .withColumn("avg_duration_s", F.bround("_d", 0)).drop("_d")
            .orderBy(F.col("conversion_pct").desc(), "device"))


def recommendations(v: Views, as_of: Column | None = None) -> DataFrame:
    """Monthly payment-method recommendations per merchant (3 segments)."""
    as_of = as_of if as_of is not None else v.tx_as_of
    m = v.merchants.select("merchant_id")
    start = F.trunc(F.to_date(as_of), "month")
    methods = ["card", "wallet", "bank_transfer"]
    recs = F.array(*[F.struct(F.lit(seg).alias("segment"),
                              F.element_at(F.array(*[F.lit(x) for x in methods]),
                                           ((F.col("merchant_id") + i) % 3).cast("int") + 1).alias("suggested_method"),
                              ((F.lit(55) + (F.col("merchant_id") * 7 + i * 13) % 41).cast("double") / 100)
                              .alias("confidence"))
                     for i, seg in enumerate(["high_value", "mid_value", "low_value"])])
    return m.select("merchant_id", start.alias("valid_from"), F.add_months(start, 1).alias("valid_until"),
                    recs.alias("recommendations"), F.lit("personalization-v1.3").alias("model_version"))


def recommendations_with_nps(v: Views, k: int = 5, as_of: Column | None = None) -> DataFrame:
    """Valid recommendations joined to the merchant's feedback NPS (merchants without
    feedback drop out, as with ``$lookup`` + ``$unwind``)."""
    as_of = as_of if as_of is not None else v.tx_as_of
    r = recommendations(v, as_of).filter(F.col("valid_until") >= F.to_date(as_of))
    nps = v.feedback.groupBy("merchant_id").agg(F.avg("nps_score").alias("_nps"), F.count(F.lit(1)).alias("feedbacks"))
    best = F.element_at("recommendations", 1)
    return (r.join(nps, "merchant_id")
            .select("merchant_id", "model_version", "feedbacks", F.bround("_nps", 1).alias("avg_nps"),
                    best["segment"].alias("best_segment"), best["suggested_method"].alias("best_method"),
                    best["confidence"].alias("best_confidence"))
            .orderBy("avg_nps", "merchant_id").limit(k))


def critical_latest(v: Views, k: int = 5, feats: DataFrame | None = None) -> DataFrame:
    """Latest critical predictions (filtered sort + limit)."""
    mf = feats if feats is not None else ml_features(v)
    return (mf.filter(F.col("prediction.risk_level") == "critical")
            .select("transaction_id", "computed_at", F.col("prediction.fraud_probability").alias("fraud_probability"))
            .orderBy(F.col("computed_at").desc(), "transaction_id").limit(k))
