"""Declared schemas of the transactional tables (no inference in production paths)."""

from pyspark.sql import types as T

S, L, I, B, TS, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType(), T.DateType()
MONEY, RATE, SCORE = T.DecimalType(14, 2), T.DecimalType(18, 8), T.DecimalType(5, 4)


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


OLTP = {
    "countries": _s(("country_code", S), ("name", S), ("region", S), ("data_region", S), ("gdpr_applies", B)),
    "currencies": _s(("currency_code", S), ("name", S), ("symbol", S), ("decimal_places", T.ShortType())),
    "exchange_rates": _s(("rate_date", D), ("currency_code", S), ("rate_to_usd", RATE), ("source", S)),
    "merchants": _s(("merchant_id", S), ("name", S), ("country_code", S), ("category", S), ("mcc", S),
                    ("status", S), ("created_at", TS), ("updated_at", TS)),
    "customers": _s(("customer_id", S), ("email", S), ("country_code", S), ("created_at", TS), ("updated_at", TS),
                    ("deleted_at", TS)),
    "payment_methods": _s(("payment_method_id", S), ("customer_id", S), ("type", S), ("brand", S), ("last4", S),
                          ("token", S), ("fingerprint", S), ("exp_month", T.ShortType()), ("exp_year", T.ShortType()),
                          ("is_default", B), ("created_at", TS)),
    "products": _s(("product_id", S), ("merchant_id", S), ("name", S), ("unit_price", MONEY), ("currency_code", S),
                   ("billing_interval", S), ("active", B), ("created_at", TS)),
    "subscriptions": _s(("subscription_id", S), ("customer_id", S), ("merchant_id", S), ("product_id", S),
                        ("status", S), ("current_period_start", D), ("current_period_end", D), ("canceled_at", TS),
                        ("created_at", TS), ("updated_at", TS)),
    "transactions": _s(("transaction_id", S), ("merchant_id", S), ("customer_id", S), ("payment_method_id", S),
                       ("product_id", S), ("subscription_id", S), ("amount", MONEY), ("currency_code", S),
                       ("status", S), ("failure_reason", S), ("ip_address", S), ("geo_country_code", S),
                       ("geo_city", S), ("device_type", S), ("idempotency_key", S), ("created_at", TS),
                       ("updated_at", TS)),
    "refunds": _s(("refund_id", S), ("transaction_id", S), ("amount", MONEY), ("reason", S), ("status", S),
                  ("created_at", TS)),
    "disputes": _s(("dispute_id", S), ("transaction_id", S), ("amount", MONEY), ("reason", S), ("status", S),
                   ("evidence_due_by", D), ("opened_at", TS), ("resolved_at", TS)),
    "fraud_indicators": _s(("fraud_id", S), ("transaction_id", S), ("anomaly_score", SCORE), ("risk_level", S),
                           ("action_taken", S), ("model_version", S), ("flagged_at", TS)),
    "audit_logs": _s(("audit_id", S), ("event_type", S), ("table_name", S), ("record_id", S), ("user_id", S),
                     ("user_role", S), ("ip_address", S), ("query_hash", S), ("created_at", TS)),
}

# load order: parents before children (foreign keys)
LOAD_ORDER = ["countries", "currencies", "exchange_rates", "merchants", "customers", "payment_methods", "products",
              "subscriptions", "transactions", "refunds", "disputes", "fraud_indicators", "audit_logs"]

CDC_MESSAGE = _s(("topic", S), ("key", S), ("value", S), ("ingested_at", T.TimestampNTZType()))
