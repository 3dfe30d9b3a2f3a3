"""Named jobs: each takes (spark, sf_dir) and returns a DataFrame over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payflow.plans import reports_docs as D
from payflow.plans import reports_olap as O
from payflow.plans import documents as DC
from payflow.plans import enrichment as EN
from payflow.plans import jobs as J
from payflow.plans import ml as ML
from payflow.plans import monitoring as MO
from payflow.plans import privacy as P
from payflow.plans import reports_oltp as T
from payflow.plans.bindings import Views
from payflow.plans.marts import Marts
from payflow.streaming import marts as SM
from payflow.plans.store import document_streams, input_state, landed_messages, revenue_deltas, stored_months, stored_features, stored_marts, stored_views

Job = Callable[[SparkSession, str], DataFrame]


def _v(fn) -> Job:
    """Job over the payment views (staged transactions read from their stored copy)."""
    return lambda spark, sf: fn(stored_views(spark, sf))


def _m(fn) -> Job:
    """Report over the materialized star."""
    return lambda spark, sf: fn(stored_marts(spark, sf))


def _f(fn) -> Job:
    """Report over the materialized feature documents."""
    return lambda spark, sf: fn(stored_views(spark, sf), feats=stored_features(spark, sf))


def _mart(name: str) -> Job:
    """A mart built from the test tables (full lineage, no stored copy)."""
    return lambda spark, sf: getattr(Marts(Views(spark, sf)), name)


def reports() -> dict[str, Job]:
    return {
        # operational (normalized views)
        "tx_high_risk_recent": _v(T.tx_high_risk_recent),
        "merchant_failure_rate": _v(T.merchant_failure_rate),
        "merchant_usd_volume": _v(T.merchant_usd_volume),
        "velocity_bursts": lambda spark, sf: T.velocity_bursts(T.attempts(stored_views(spark, sf)), 3600, 3, 15),
        "risky_accounts": _v(T.risky_accounts),
        "shared_cards": _v(T.shared_cards),
        "mrr_usd": _v(T.mrr_usd),
        "sensitive_access": _v(T.sensitive_access),
        "failed_last": lambda spark, sf: T.failed_last(stored_months(spark, sf)),
        # analytical (star)
        "rev_monthly_cumulative": _m(O.rev_monthly_cumulative),
        "spend_deciles": _m(O.spend_deciles),
        "segment_summary": _m(O.segment_summary),
        "fraud_rate_quarterly": _m(O.fraud_rate_quarterly),
        "pm_performance": _m(O.pm_performance),
        "merchant_retention": _m(O.merchant_retention),
        "daily_revenue_ma7": _m(O.daily_revenue_ma7),
        "product_performance": _m(O.product_performance),
        "compliance_monthly": _m(O.compliance_monthly),
        "scd2_as_was_as_is": _m(O.scd2_as_was_as_is),
        "preagg_equality": _m(O.preagg_equality),
        # documents
        "logs_critical": _v(D.logs_critical),
        "suspicious_sessions": _v(D.suspicious_sessions),
        "high_risk_explained": _f(D.high_risk_explained),
        "tag_rollup": _v(D.tag_rollup),
        "latency_sla": _v(D.latency_sla),
        "latency_p95_floor": _v(D.latency_p95_floor),
        "latency_sla_approx": _v(D.latency_sla_approx),
        "precision_by_risk": _f(D.precision_by_risk),
        "recall_overall": _f(D.recall_overall),
        "checkout_funnel": _v(D.checkout_funnel),
        "conversion_by_device": _v(D.conversion_by_device),
        "recommendations_with_nps": _v(D.recommendations_with_nps),
        "critical_latest": _f(D.critical_latest),
        # batch jobs: refunds fold, CDC staging, quality gate, privacy
        "guarded_refunds": _v(J.guarded_refunds),
        "stage_transactions": lambda spark, sf: J.staged(stored_views(spark, sf), landed_messages(spark, sf)),
        "dead_letter_report": lambda spark, sf: J.dead_letter_report(landed_messages(spark, sf)),
        "quality_report": lambda spark, sf: J.quality_report(stored_marts(spark, sf), stored_features(spark, sf)),
        "volume_anomalies_daily": lambda spark, sf: J.volume_anomalies_daily(stored_views(spark, sf).tx),
        "erased_customers": _v(P.erased_customers_report),
        "erasure_residue": lambda spark, sf: P.erasure_residue_report(
            stored_views(spark, sf), stored_features(spark, sf), stored_marts(spark, sf).dim_customer),
        "erased_payment_methods": _v(P.erased_payment_methods),
        "erasure_audit": _v(P.erasure_audit),
        "retention_summary": _v(P.retention_summary),
        "feature_retention": lambda spark, sf: P.feature_retention(stored_views(spark, sf), stored_features(spark, sf)),
        "documents_with_cards": _v(P.documents_with_cards),
        "residency_check": lambda spark, sf: P.residency_check(
            stored_marts(spark, sf).dim_customer, stored_views(spark, sf).countries),
        "off_hours_access": _v(P.off_hours_access),
        "subject_access_export": _v(P.subject_access_export),
        # model evaluation and monitoring
        "pr_curve": lambda spark, sf: ML.pr_curve(ML.labeled(stored_features(spark, sf))),
        "auc_summary": lambda spark, sf: ML.auc_summary(ML.labeled(stored_features(spark, sf))),
        "policy_table": lambda spark, sf: ML.policy_table(ML.labeled(stored_features(spark, sf))),
        "classification_report": lambda spark, sf: ML.classification_report(ML.labeled(stored_features(spark, sf))),
        "champion_challenger": lambda spark, sf: ML.champion_challenger(stored_features(spark, sf)),
        "training_set_summary": lambda spark, sf: ML.training_set_summary(stored_features(spark, sf)),
        "fraud_model_evaluation": lambda spark, sf: ML.model_evaluation(stored_features(spark, sf), key=input_state(spark, sf)),
        "fraud_feature_importance": lambda spark, sf: ML.feature_importance(stored_features(spark, sf), key=input_state(spark, sf)),
        "reference_feature_importance": lambda spark, sf: ML.reference_importance(stored_features(spark, sf)),
        "fraud_permutation_importance": lambda spark, sf: ML.model_importance(stored_features(spark, sf), key=input_state(spark, sf)),
        "recommended_methods": _v(ML.recommend_methods),
        "merchant_segment_methods": _v(lambda v: ML.joined_methods(ML.recommend_by_merchant_segment(v))),
        "merchant_segment_fallback": _v(lambda v: ML.joined_methods(ML.merchant_segment_fallback(v))),
        "interaction_matrix": _v(ML.interaction_matrix),
        "similar_embeddings": ML.similar_embeddings,
        "canary_assignment": _v(ML.canary_assignment),
        "recommendation_uplift": _v(ML.recommendation_uplift),
        "hard_rule_summary": lambda spark, sf: MO.hard_rule_summary(stored_views(spark, sf), stored_features(spark, sf)),
        "feature_drift": lambda spark, sf: MO.feature_drift(stored_features(spark, sf)),
        "fairness_block_rate": _v(MO.fairness_block_rate),
        "proxy_rate_alerts": _v(MO.proxy_rate_alerts),
        "merchant_churn_features": _m(MO.merchant_churn_features),
        "region_volume_anomalies": _m(MO.region_volume_anomalies),
        "lag_report": lambda spark, sf: MO.lag_report(J.parse_cdc(landed_messages(spark, sf))),
        "ip_blocklist_hits": _v(MO.ip_blocklist_hits),
        "login_failure_bursts": _v(MO.login_failure_bursts),
        "export_bursts": _v(MO.export_bursts),
        "revenue_yoy_quarterly": _m(MO.revenue_yoy_quarterly),
        "revenue_by_weekday_hour": _m(MO.revenue_by_weekday_hour),
        "amount_stats_by_currency": _v(MO.amount_stats_by_currency),
        "merchants_with_mcc": _v(MO.merchants_with_mcc),
        "session_buckets": _v(MO.session_buckets),
        # cross-store views, mart maintenance reports, document checks, privacy deadlines
        "analyst_view": _v(EN.analyst_view),
        "holistic_view": lambda spark, sf: EN.holistic_view(stored_views(spark, sf), stored_features(spark, sf)),
        "source_row_counts": _v(EN.source_row_counts),
        "top_products_per_merchant": _m(EN.top_products_per_merchant),
        "merchant_name_drift": _v(EN.merchant_name_drift),
        "fact_feedback": _m(EN.fact_feedback),
        "fact_sessions": _m(EN.fact_sessions),
        "session_stream": lambda spark, sf: EN.fact_sessions(
            stored_marts(spark, sf), DC.streamed_sessions(spark, f"{document_streams(spark, sf)}/sessions")),
        "daily_revenue_stream": lambda spark, sf: SM.read_mart(spark, revenue_deltas(spark, sf)).withColumn(
            "total_amount", F.col("total_amount").cast("double")),
        "feedback_stream": lambda spark, sf: EN.fact_feedback(
            stored_marts(spark, sf), DC.streamed_feedback(spark, f"{document_streams(spark, sf)}/feedback")),
        "document_schema_violations": _v(EN.document_schema_violations),
        "feature_schema_violations": lambda spark, sf: EN.feature_schema_violations(stored_features(spark, sf)),
        "overdue_privacy_requests": _v(P.overdue_requests),
        # marts
        "dim_date": _mart("dim_date"),
        "dim_geography": _mart("dim_geography"),
        "dim_currency": _mart("dim_currency"),
        "dim_payment_method": _mart("dim_payment_method"),
        "dim_product": _mart("dim_product"),
        "dim_merchant": _mart("dim_merchant"),
        "dim_customer": _mart("dim_customer"),
        "fact_transactions": _mart("fact_transactions"),
        "fact_audit_events": _mart("fact_audit_events"),
        "agg_daily_revenue": _mart("agg_daily_revenue"),
        "agg_monthly_fraud": _mart("agg_monthly_fraud"),
        "mv_monthly_revenue_by_country": _mart("mv_monthly_revenue_by_country"),
    }


def all_jobs() -> dict[str, Job]:
    return reports()
