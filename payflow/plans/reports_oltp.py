"""Operational reports over the normalized payment views (risk ops, finance, compliance).

``as_of`` is a parameter; when omitted it is the latest timestamp of the view the
report reads (a scalar subquery, never the wall clock).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payflow.functions import pct
from payflow.operators.aggregates import mode_of
from payflow.operators.lists import chunked_string_agg
from payflow.operators.windows import count_in_range
from payflow.plans.bindings import Views
from payflow.session import ensure_checkpoint_dir


def latest(df: DataFrame, ts: str) -> Column:
    """``(SELECT max(ts) FROM df)`` as a scalar subquery column."""
    return df.agg(F.max(ts)).scalar()


def since(ts: str, as_of: Column, days: int) -> Column:
    return F.col(ts) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def tx_high_risk_recent(v: Views, days: int = 90, k: int = 20, as_of: Column | None = None) -> DataFrame:
    """Recent high / critical transactions, top k by anomaly score."""
    tx = v.tx
    as_of = as_of if as_of is not None else v.tx_as_of
    fi = v.fraud_indicators.filter(F.col("risk_level").isin("high", "critical")) \
        .select("transaction_id", "anomaly_score", "risk_level", "action_taken")
    m = v.merchants.select("merchant_id", F.col("name").alias("merchant_name"))
    c = v.customers.select("customer_id", F.col("country_code").alias("customer_country"))
    return (tx.filter(since("created_at", as_of, days))
            .join(fi, "transaction_id").join(m, "merchant_id").join(c, "customer_id")
            .select("transaction_id", "created_at", F.col("amount").cast("double").alias("amount"),
                    "currency_code", "status", F.col("anomaly_score").cast("double").alias("anomaly_score"),
                    "risk_level", "action_taken", "merchant_name", "customer_id", "geo_country_code",
                    "customer_country", "device_type")
            .orderBy(F.col("anomaly_score").desc(), F.col("transaction_id")).limit(k))


def merchant_failure_rate(v: Views, days: int = 30, min_n: int = 3, k: int = 10,
                          as_of: Column | None = None) -> DataFrame:
    """Failure rate per merchant and the dominant failure reason (mode, ties -> smallest)."""
    tx = v.tx
    as_of = as_of if as_of is not None else v.tx_as_of
    m = v.merchants.select("merchant_id", F.col("name").alias("merchant_name"), "category")
    g = (tx.filter(since("created_at", as_of, days)).join(m, "merchant_id")
         .groupBy("merchant_id", "merchant_name", "category")
         .agg(F.count(F.lit(1)).alias("total_transactions"),
              F.count_if(F.col("status") == "failed").alias("failed_count"),
              mode_of("failure_reason").alias("top_failure_reason")))
    return (g.filter(F.col("total_transactions") >= min_n)
            .withColumn("failure_rate_pct", pct(F.col("failed_count"), F.col("total_transactions")))
            .orderBy(F.col("failure_rate_pct").desc(), F.col("total_transactions").desc(), "merchant_id")
            .limit(k))


def to_usd(tx: DataFrame, fx: DataFrame, how: str = "inner") -> DataFrame:
    """Join the day rate on (currency, calendar date); fx is days x currencies (broadcast)."""
    r = F.broadcast(fx.select(F.col("currency_code").alias("_cur"), "rate_date", "rate_to_usd"))
    return (tx.join(r, (F.col("currency_code") == F.col("_cur")) & (F.to_date("created_at") == F.col("rate_date")),
                    how).drop("_cur"))


def merchant_usd_volume(v: Views, days: int = 90, k: int = 10, as_of: Column | None = None) -> DataFrame:
    """Top merchants by USD volume at the day rate; distinct currencies listed in order."""
    tx = v.tx
    as_of = as_of if as_of is not None else v.tx_as_of
    m = v.merchants.select("merchant_id", F.col("name").alias("merchant_name"), "category", "country_code")
    co = F.broadcast(v.countries.select("country_code", F.col("name").alias("country")))
    t = to_usd(tx.filter((F.col("status") == "succeeded") & since("created_at", as_of, days)), v.fx)
    usd = F.col("amount") * F.col("rate_to_usd")
    return (t.join(m, "merchant_id").join(co, "country_code")
            .groupBy("merchant_id", "merchant_name", "category", "country")
            .agg(F.count("transaction_id").alias("transaction_count"),
                 F.round(F.sum(usd), 2).cast("double").alias("total_volume_usd"),
                 F.round(F.sum(usd) / F.count(usd), 2).cast("double").alias("avg_ticket_usd"),
                 F.array_join(F.array_sort(F.collect_set("currency_code")), ", ").alias("currencies"))
            .orderBy(F.col("total_volume_usd").desc(), "merchant_id").limit(k))


def attempts(v: Views) -> DataFrame:
    """Payment attempts replayed from the event stream (dense in time: used for velocity)."""
    e = v.table("events")
    return e.select(F.col("event_id").alias("transaction_id"), F.col("user_id").alias("customer_id"),
                    (F.col("user_id") % 10).alias("merchant_id"),
                    F.col("value").cast("decimal(14,2)").alias("amount"), F.col("ts").alias("created_at"))


def velocity_bursts(df: DataFrame, window_s: int = 3600, min_n: int = 3, k: int = 15) -> DataFrame:
    """(customer, merchant) pairs whose rows reach ``min_n`` in a ``window_s`` range frame.

    The pair aggregate is computed first; the id list is built only for the k winners,
    in chunks of at most 1000 ids (``id_chunk``), so a hot pair never lands in one row.
    """
    w = count_in_range(df, ["customer_id", "merchant_id"], "created_at", window_s, "tx_in_window")
    ensure_checkpoint_dir(df.sparkSession)
    hot = w.filter(F.col("tx_in_window") >= min_n).checkpoint(eager=True)      # read twice: for the winners, for their ids
    g = (hot.groupBy("customer_id", "merchant_id")
         .agg(F.min("created_at").alias("burst_start"), F.max("created_at").alias("burst_end"),
              F.count(F.lit(1)).alias("transactions_in_burst"),
              F.round(F.sum("amount"), 2).cast("double").alias("total_amount"))
         .orderBy(F.col("transactions_in_burst").desc(), F.col("burst_start").desc(), "customer_id", "merchant_id")
         .limit(k))
    winners = hot.join(g.select("customer_id", "merchant_id"), ["customer_id", "merchant_id"], "left_semi")
    ids = chunked_string_agg(winners, ["customer_id", "merchant_id"], F.col("transaction_id"), "transaction_ids")
    return g.join(ids, ["customer_id", "merchant_id"])


def risky_accounts(v: Views, k: int = 15) -> DataFrame:
    """Customers with >= 2 payment methods among their flagged transactions."""
    c = v.customers.select("customer_id", "country_code")
    t = v.tx.select("transaction_id", "customer_id", "payment_method_id")
    fi = v.fraud_indicators.select("transaction_id", "fraud_id", "anomaly_score")
    d = v.disputes.select("transaction_id", "dispute_id")
    j = c.join(t, "customer_id").join(fi, "transaction_id").join(d, "transaction_id", "left")
    return (j.groupBy("customer_id", "country_code")
            .agg(F.countDistinct("payment_method_id").alias("distinct_payment_methods"),
                 F.countDistinct("transaction_id").alias("total_transactions"),
                 F.countDistinct("fraud_id").alias("fraud_flags"),
                 F.max("anomaly_score").cast("double").alias("max_anomaly_score"),
                 F.countDistinct("dispute_id").alias("disputes"))
            .filter(F.col("distinct_payment_methods") >= 2)
            .orderBy(F.col("fraud_flags").desc(), F.col("max_anomaly_score").desc(), "customer_id").limit(k))


def shared_cards(v: Views) -> DataFrame:
    """Card fingerprints used by several customers."""
    pm = v.payment_methods.filter(F.col("fingerprint").isNotNull()) \
        .select("payment_method_id", "customer_id", "fingerprint", "brand")
    t = v.tx.select("transaction_id", "payment_method_id")
    fi = v.fraud_indicators.select("transaction_id", "fraud_id")
    j = pm.join(t, "payment_method_id", "left").join(fi, "transaction_id", "left")
    g = (j.groupBy("fingerprint", "brand")
         .agg(F.countDistinct("customer_id").alias("distinct_customers"),
              F.count("transaction_id").alias("transactions"),
              F.count("fraud_id").alias("fraud_flags"))
         .filter(F.col("distinct_customers") >= 2))
    # a card shared by very many accounts is listed over several rows of <= 1000 ids
    owners = pm.select("fingerprint", "brand", "customer_id").distinct() \
        .join(g.select("fingerprint", "brand"), ["fingerprint", "brand"], "left_semi")
    ids = chunked_string_agg(owners, ["fingerprint", "brand"], F.col("customer_id"), "customer_ids")
    return (g.join(ids, ["fingerprint", "brand"])
            .select("fingerprint", "brand", "distinct_customers", "id_chunk", "customer_ids", "transactions",
                    "fraud_flags")
            .orderBy(F.col("distinct_customers").desc(), F.col("fraud_flags").desc(), "fingerprint", "id_chunk"))


def to_usd_latest(df: DataFrame, fx: DataFrame) -> DataFrame:
    """C4: rate of the latest rate date (uncorrelated scalar subquery, evaluated once)."""
    last = fx.agg(F.max("rate_date")).scalar()
    r = F.broadcast(fx.filter(F.col("rate_date") == last)
                    .select(F.col("currency_code").alias("_cur"), "rate_to_usd"))
    return df.join(r, F.col("currency_code") == F.col("_cur")).drop("_cur")


def mrr_usd(v: Views, k: int = 10) -> DataFrame:
    """Monthly recurring revenue in USD (yearly price / 12) per merchant."""
    s = v.subscriptions.select("subscription_id", "product_id", "merchant_id", "status")
    p = v.products.select("product_id", "unit_price", "currency_code", "billing_interval")
    m = v.merchants.select("merchant_id", F.col("name").alias("merchant_name"))
    j = to_usd_latest(s.join(p, "product_id").join(m, "merchant_id"), v.fx)
    usd = F.col("unit_price") * F.col("rate_to_usd")
    active = F.col("status") == "active"
    yearly = F.col("billing_interval") == "year"
    zero = F.lit(Decimal("0"))
    g = (j.groupBy("merchant_id", "merchant_name")
         .agg(F.count_if(active).alias("active_subscriptions"),
              F.count_if(F.col("status") == "past_due").alias("past_due"),
              F.count_if(F.col("status") == "canceled").alias("canceled"),
              # 12 x monthly equivalent, exact in decimal; divided once at the end
              F.sum(F.when(active & yearly, usd).when(active, usd * F.lit(Decimal("12")))
                    .otherwise(zero)).alias("_mrr12")))
    return (g.filter(F.col("active_subscriptions") > 0)
            .withColumn("mrr_usd", F.round(F.col("_mrr12").cast("double") / 12, 2)).drop("_mrr12")
            .orderBy(F.col("mrr_usd").desc(), "merchant_id").limit(k))


def sensitive_access(v: Views, days: int = 30, as_of: Column | None = None) -> DataFrame:
    """Who touched sensitive data, by role, event and table."""
    a = v.audit_logs
    as_of = as_of if as_of is not None else latest(a, "created_at")
    f = a.filter(since("created_at", as_of, days)
                 & (F.col("table_name").isin("payment_methods", "customers")
                    | F.col("event_type").isin("EXPORT", "ERASURE", "LOGIN_FAILED")))
    return (f.groupBy("user_role", "event_type", "table_name")
            .agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("distinct_users"),
                 F.max("created_at").alias("last_event"))
            .orderBy(F.col("events").desc(), "user_role", "event_type", "table_name"))


def failed_last(tx: DataFrame, days: int = 30, as_of: Column | None = None) -> DataFrame:
    """Failed rows of the last ``days``. On a ``year_month``-partitioned table the
    month bound derived from the time bound is pushed as a partition filter."""
    as_of = as_of if as_of is not None else latest(tx, "created_at")
    lo = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    cond = (F.col("status") == "failed") & (F.col("created_at") >= lo)
    if "year_month" in tx.columns:
        cond = cond & (F.col("year_month") >= F.date_format(lo, "yyyy-MM"))
    return tx.filter(cond).select("transaction_id", "merchant_id", "failure_reason", "created_at")
