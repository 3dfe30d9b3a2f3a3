"""Cross-store views and mart maintenance: holistic view, feedback facts, copy
reconciliation, segment migrations, partial refresh, row counts, per-merchant top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payflow.operators.scd2 import scd2_apply
from payflow.plans.bindings import Views
from payflow.plans.marts import Marts
from payflow.sources.sinks import _fs


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table as one UNION ALL of counts."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def source_row_counts(v: Views) -> DataFrame:
    return row_counts({"transactions": v.tx, "refunds": v.refunds, "disputes": v.disputes,
                       "fraud_indicators": v.fraud_indicators, "payment_methods": v.payment_methods,
                       "subscriptions": v.subscriptions, "audit_logs": v.audit_logs, "merchants": v.merchants,
                       "customers": v.customers, "products": v.products})


def analyst_view(v: Views) -> DataFrame:
    """Pseudonymized payments for analysts: no email, IP cut to its /24 network."""
    from payflow.functions import ip_to_24
    return v.tx.select("transaction_id", "merchant_id", "customer_id", F.col("amount").cast("double").alias("amount"),
                       "currency_code", "status", "failure_reason",
                       ip_to_24(F.col("ip_address")).alias("ip_network"), "geo_country_code", "device_type",
                       "created_at")


def holistic_view(v: Views, feats: DataFrame) -> DataFrame:
    """Money x behaviour x risk on the payment id (two left joins)."""
    t = v.tx.select("transaction_id", "customer_id", "merchant_id", F.col("amount").cast("double").alias("amount"),
                    "status")
    p = feats.select("transaction_id", F.col("prediction.risk_level").alias("risk_level"),
                     F.col("prediction.fraud_probability").alias("fraud_probability"),
                     F.col("label.is_fraud").alias("label"))
    fb = v.feedback.select("transaction_id", F.col("scores.overall").alias("feedback_score"), "nps_score")
    return t.join(p, "transaction_id", "left").join(fb, "transaction_id", "left")


def fact_feedback(m: Marts, documents: DataFrame | None = None) -> DataFrame:
    """Feedback documents (default: the views') flattened into a fact with the star's keys."""
    fb = documents if documents is not None else m.v.feedback
    mer = m.dim_merchant.filter("is_current").select("merchant_id", "merchant_sk")
    cus = m.dim_customer.select("customer_id", "customer_sk")
    d = F.broadcast(m.dim_date.select(F.col("full_date").alias("_d"), "date_sk"))
    return (fb.join(mer, "merchant_id", "left").join(cus, "customer_id", "left")
            .join(d, F.to_date("submitted_at") == F.col("_d"), "left")
            .select("feedback_id", "transaction_id", "date_sk", "merchant_sk", "customer_sk",
                    F.col("scores.overall").alias("overall"), "nps_score", F.size("tags").alias("n_tags")))


def fact_sessions(m: Marts, documents: DataFrame | None = None) -> DataFrame:
    """Session documents (default: the views') flattened into a fact with the star's keys."""
    sessions = documents if documents is not None else m.v.sessions
    cus = m.dim_customer.filter("is_current").select("customer_id", "customer_sk")
    d = F.broadcast(m.dim_date.select(F.col("full_date").alias("_d"), "date_sk"))       # one row per day
    return (sessions.join(cus, "customer_id", "left").join(d, F.to_date("session_start") == F.col("_d"), "left")
            .select("session_id", "date_sk", "customer_sk", "device_type", "event_count", "pay_clicks", "converted",
                    "duration_seconds"))


def reconcile_copies(docs: DataFrame, source: DataFrame, key: str, copy_col: str, source_col: str) -> DataFrame:
    """Denormalized copies overwritten from the source of truth, with a drift flag."""
    s = source.select(key, F.col(source_col).alias("_src"))
    j = docs.join(s, key, "left")
    return (j.withColumn("drifted", F.coalesce(F.col(copy_col) != F.col("_src"), F.lit(False)))
            .withColumn(copy_col, F.coalesce("_src", F.col(copy_col))).drop("_src"))


def merchant_name_drift(v: Views) -> DataFrame:
    """I19 report: feedback documents whose copied merchant name differs from the merchant's."""
    fb = v.feedback.select("feedback_id", "merchant_id", "merchant_name")
    r = reconcile_copies(fb, v.merchants, "merchant_id", "merchant_name", "name")
    return r.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("documents"),
                                        F.count_if("drifted").alias("drifted"))


def segment_migrations(dim_before: DataFrame, segments_now: DataFrame, as_of: str) -> DataFrame:
    """SCD2 on the customer segment; returns the migrations (old -> new) at ``as_of``."""
    applied = scd2_apply(dim_before, segments_now, "customer_id", ["segment"], as_of)
    closed = applied.filter(F.col("scd_end") == F.to_date(F.lit(as_of))).select("customer_id",
                                                                               F.col("segment").alias("from_segment"))
    opened = applied.filter((F.col("scd_start") == F.to_date(F.lit(as_of))) & F.col("is_current")) \
        .select("customer_id", F.col("segment").alias("to_segment"))
    return closed.join(opened, "customer_id")


def refresh_agg(fact: DataFrame, agg_fn, path: str, days: int = 2, as_of: Column | None = None) -> None:
    """Recompute only the last ``days`` days of a ``date_sk``-partitioned aggregate and
    replace just those partitions (late data within the window is picked up); a day of the window
    that has no rows any more loses its partition."""
    as_of = as_of if as_of is not None else fact.agg(F.max("loaded_at")).scalar()
    lo = F.date_format(F.date_sub(F.to_date(as_of), days - 1), "yyyyMMdd").cast("int")
    recent = agg_fn(fact.filter(F.col("date_sk") >= lo))
    (recent.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date_sk")
     .parquet(path))
    spark = fact.sparkSession
    first = spark.range(1).select(lo.alias("lo")).first()["lo"]
    kept = {r["date_sk"] for r in fact.filter(F.col("date_sk") >= lo).select("date_sk").distinct().collect()}     # days
    fs, p = _fs(spark, path)
    for day in fs.listStatus(p):
        name = day.getPath().getName()
        if name.startswith("date_sk=") and name[8:].isdigit() and int(name[8:]) >= first and int(name[8:]) not in kept:
            fs.delete(day.getPath(), True)


def top_products_per_merchant(m: Marts, k: int = 3) -> DataFrame:
    """top-k products per merchant by revenue (ties: smaller product id first).

    Rows are first reduced to one per (merchant, product); the top k are then picked by
    ``first_k_by`` (k rows per group and map task), so a merchant that sells
    most of the catalogue is never sorted in one task."""
    from payflow.operators.topk import first_k_by
    f = m.fact_transactions.filter(F.col("status") == "succeeded")
    mer = m.dim_merchant.select("merchant_sk", "merchant_id")
    p = m.dim_product.select("product_sk", "product_id")
    g = (f.join(mer, "merchant_sk").join(p, "product_sk").groupBy("merchant_id", "product_id")
         .agg(F.sum("amount_usd").alias("_rev"), F.count(F.lit(1)).alias("sales")))
    g = g.select("merchant_id", "product_id", (-F.col("_rev")).alias("_neg"),
                 F.struct("product_id", "sales", "_rev").alias("_val"))
    top = first_k_by(g, ["merchant_id"], ["_neg", "product_id"], "_val", k, "_top")
    return (top.select("merchant_id", F.posexplode("_top").alias("_p", "_x"))
            .select("merchant_id", F.col("_x.product_id").alias("product_id"), F.col("_x.sales").alias("sales"),
                    (F.col("_p") + 1).cast("int").alias("rank"),
                    F.col("_x._rev").cast("double").alias("revenue_usd")))


def document_schema_violations(v: Views) -> DataFrame:
    """Validator rules of the session and feedback collections as violation counts."""
    from payflow.operators.checks import rule_violations
    s = rule_violations(v.sessions, {
        "sessions.required_fields": F.col("session_id").isNotNull() & F.col("customer_id").isNotNull()
        & F.col("session_start").isNotNull(),
        "sessions.max_500_events": F.col("event_count") <= 500,
        "sessions.device_enum": F.col("device_type").isin("mobile", "desktop", "tablet"),
        "sessions.duration_non_negative": F.col("duration_seconds") >= 0})
    fb = rule_violations(v.feedback, {
        "feedback.overall_1_5": F.col("scores.overall").between(1, 5),
        "feedback.nps_0_10": F.col("nps_score").between(0, 10),
        "feedback.required_fields": F.col("feedback_id").isNotNull() & F.col("submitted_at").isNotNull()})
    return s.unionByName(fb)


def feature_schema_violations(feats: DataFrame) -> DataFrame:
    """Validator rules of the feature documents (``ml_features``) as violation counts."""
    from payflow.operators.checks import rule_violations
    need = ["transaction_id", "computed_at", "model_target", "features", "prediction",
            "prediction.fraud_probability", "prediction.risk_level", "prediction.model_version"]
    required = F.lit(True)
    for c in need:
        required = required & F.col(c).isNotNull()
    return rule_violations(feats, {
        "ml_features.required_fields": required,
        "ml_features.fraud_probability_0_1": F.col("prediction.fraud_probability").between(0, 1),
        "ml_features.risk_level_enum": F.col("prediction.risk_level").isin("low", "medium", "high", "critical")})
