"""Analytical reports over the star schema (finance, marketing, risk, compliance)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payflow.functions import months_between_ym, pct
from payflow.operators.ranks import ntile
from payflow.plans.marts import Marts
from payflow.plans.reports_oltp import latest

DEFAULT_COUNTRIES = ("C01", "C06", "C23")


def _avg2(x: str | Column) -> Column:
    """AVG of money rounded half-up to cents from the exact decimal quotient, as double."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(F.sum(x) / F.count(x), 2).cast("double")


def rev_monthly_cumulative(m: Marts, countries=DEFAULT_COUNTRIES) -> DataFrame:
    """Monthly revenue by country x payment type with the running total within the year."""
    f = m.fact_transactions.filter((F.col("status") == "succeeded") & ~F.col("is_fraud_flagged"))
    d = F.broadcast(m.dim_date.select("date_sk", "year", "month"))
    g = F.broadcast(m.dim_geography.filter(F.col("country_code").isin(*countries))
                    .select("geography_sk", "country_name"))
    pm = F.broadcast(m.dim_payment_method.select("payment_method_sk", F.col("type").alias("payment_type")))
    agg = (f.join(g, "geography_sk").join(d, "date_sk").join(pm, "payment_method_sk")
           .groupBy("year", "month", "country_name", "payment_type")
           .agg(F.count(F.lit(1)).alias("transaction_count"),
                F.sum("amount_usd").alias("_rev"),
                F.round(F.sum("net_amount_usd"), 2).cast("double").alias("net_revenue_usd"),
                _avg2("amount_usd").alias("avg_ticket_usd")))
    w = Window.partitionBy("year", "country_name", "payment_type").orderBy("month") \
        .rowsBetween(Window.unboundedPreceding, 0)
    return (agg.withColumn("cumulative_revenue_usd", F.round(F.sum("_rev").over(w), 2).cast("double"))
            .withColumn("revenue_usd", F.round("_rev", 2).cast("double")).drop("_rev")
            .orderBy("country_name", "payment_type", "year", "month"))


def _customer_spending(m: Marts) -> DataFrame:
    f = m.fact_transactions.filter(F.col("status") == "succeeded")
    c = m.dim_customer.filter("is_current").select("customer_sk", "region", "segment")
    return (f.join(c, "customer_sk").groupBy("customer_sk", "region", "segment")
            .agg(F.sum("amount_usd").alias("total_spent_usd"), F.count(F.lit(1)).alias("transaction_count")))


def spend_deciles(m: Marts) -> DataFrame:
    """NTILE(10) of customer spend (global rank computed without one-task window)."""
    dec = ntile(_customer_spending(m), ["total_spent_usd", "customer_sk"], 10, "spending_decile")
    g = (dec.groupBy("spending_decile")
         .agg(F.count(F.lit(1)).alias("customer_count"), _avg2("total_spent_usd").alias("avg_spent_usd"),
              F.round(F.min("total_spent_usd"), 2).cast("double").alias("min_spent_usd"),
              F.round(F.max("total_spent_usd"), 2).cast("double").alias("max_spent_usd"),
              F.sum("total_spent_usd").alias("_rev")))
    total = F.sum("_rev").over(Window.partitionBy())      # 10 rows
    return (g.withColumn("pct_total_revenue", F.round(F.col("_rev").cast("double") * 100 / total.cast("double"), 2))
            .withColumn("decile_revenue_usd", F.round("_rev", 2).cast("double")).drop("_rev")
            .orderBy("spending_decile"))


def segment_summary(m: Marts) -> DataFrame:
    """Revenue share per persisted customer segment."""
    f = m.fact_transactions.filter(F.col("status") == "succeeded")
    c = m.dim_customer.filter("is_current").select("customer_sk", "segment")
    g = (f.join(c, "customer_sk").groupBy("segment")
         .agg(F.countDistinct("customer_sk").alias("customers"), F.sum("amount_usd").alias("_rev"),
              _avg2("amount_usd").alias("avg_ticket_usd")))
    total = F.sum("_rev").over(Window.partitionBy())      # <= 3 rows
    return (g.withColumn("pct_revenue", F.round(F.col("_rev").cast("double") * 100 / total.cast("double"), 1))
            .withColumn("revenue_usd", F.round("_rev", 2).cast("double")).drop("_rev")
            .orderBy(F.col("revenue_usd").desc()))


def fraud_rate_quarterly(m: Marts) -> DataFrame:
    """Quarterly fraud rate by region and its change vs the previous present quarter."""
    f = m.fact_transactions
    d = F.broadcast(m.dim_date.select("date_sk", "year", "quarter"))
    g = F.broadcast(m.dim_geography.select("geography_sk", "region"))
    q = (f.join(d, "date_sk").join(g, "geography_sk").groupBy("year", "quarter", "region")
         .agg(F.count(F.lit(1)).alias("total_transactions"),
              F.count_if("is_fraud_flagged").alias("fraud_count"),
              F.count_if("is_disputed").alias("dispute_count"),
              F.round(F.avg("anomaly_score"), 4).cast("double").alias("avg_anomaly_score")))
    rate = F.col("fraud_count").cast("double") * 100 / F.when(F.col("total_transactions") != 0,
                                                               F.col("total_transactions").cast("double"))
    w = Window.partitionBy("region").orderBy("year", "quarter")
    return (q.withColumn("_rate", rate).withColumn("_prev", F.lag("_rate").over(w))
            .withColumn("fraud_rate_pct", F.round("_rate", 2))
            .withColumn("prev_quarter_fraud_rate", F.round("_prev", 2))
            .withColumn("fraud_rate_delta", F.round(F.col("_rate") - F.col("_prev"), 2))
            .drop("_rate", "_prev").orderBy("region", "year", "quarter"))


def pm_performance(m: Marts) -> DataFrame:
    """Volume and four rates per region x payment type."""
    f = m.fact_transactions
    g = F.broadcast(m.dim_geography.select("geography_sk", "region"))
    pm = F.broadcast(m.dim_payment_method.select("payment_method_sk", F.col("type").alias("payment_type"),
                                                 "is_digital"))
    n = F.count(F.lit(1))
    return (f.join(g, "geography_sk").join(pm, "payment_method_sk")
            .groupBy("region", "payment_type", "is_digital")
            .agg(n.alias("transaction_count"),
                 F.round(F.sum(F.when(F.col("status") == "succeeded", F.col("amount_usd")).otherwise(0)), 2)
                 .cast("double").alias("volume_usd"),
                 pct(F.count_if(F.col("status") == "failed"), n).alias("failure_rate_pct"),
                 pct(F.count_if("is_refunded"), n).alias("refund_rate_pct"),
                 pct(F.count_if("is_fraud_flagged"), n).alias("fraud_rate_pct"),
                 pct(F.count_if("is_disputed"), n).alias("dispute_rate_pct"))
            .orderBy("region", F.col("volume_usd").desc()))


def merchant_retention(m: Marts, max_months: int = 6) -> DataFrame:
    """Merchant cohorts by first active month; share still active n months later."""
    f = m.fact_transactions.filter(F.col("status") == "succeeded")
    d = F.broadcast(m.dim_date.select("date_sk", (F.col("year") * 100 + F.col("month")).alias("ym")))
    act = f.join(d, "date_sk").select("merchant_sk", "ym")
    cohorts = act.groupBy("merchant_sk").agg(F.min("ym").alias("cohort_ym"))
    monthly = act.distinct()
    r = (cohorts.join(monthly, "merchant_sk")
         .withColumn("months_since_acquisition", months_between_ym(F.col("ym"), F.col("cohort_ym")))
         .filter(F.col("months_since_acquisition") <= max_months)
         .groupBy("cohort_ym", "months_since_acquisition")
         .agg(F.countDistinct("merchant_sk").alias("active_merchants")))
    w = Window.partitionBy("cohort_ym").orderBy("months_since_acquisition") \
        .rowsBetween(Window.unboundedPreceding, 0)
    size = F.first("active_merchants").over(w)
    return (r.withColumn("cohort_size", size)
            .withColumn("retention_rate_pct",
                        F.round(F.col("active_merchants").cast("double") * 100 / F.col("cohort_size"), 1))
            .withColumnRenamed("cohort_ym", "cohort_month")
            .orderBy("cohort_month", "months_since_acquisition"))


def daily_revenue_ma7(m: Marts, days: int = 60, k: int = 21, as_of: Column | None = None) -> DataFrame:
    """Daily revenue from the daily aggregate, 7-row moving mean, week-over-week (7 rows)."""
    a = m.agg_daily_revenue
    d = F.broadcast(m.dim_date.select("date_sk", "full_date", "day_name", "is_weekend"))
    # last day with payments, read from the (small) daily aggregate itself
    as_of = as_of if as_of is not None else F.to_date(a.agg(F.max("date_sk")).scalar().cast("string"), "yyyyMMdd")
    daily = (a.join(d, "date_sk").filter(F.col("full_date") >= F.date_sub(as_of, days))
             .groupBy("full_date", "day_name", "is_weekend")
             .agg(F.sum("total_amount_usd").alias("_rev"), F.sum("succeeded_count").alias("succeeded"),
                  F.sum("failed_count").alias("failed")))
    # one row per day inside a bounded date range: a global order is cheap here
    w = Window.orderBy("full_date")
    w7 = w.rowsBetween(-6, 0)
    prev = F.lag("_rev", 7).over(w)
    return (daily.withColumn("revenue_ma7_usd",
                             F.round(F.sum("_rev").over(w7).cast("double") / F.count("_rev").over(w7), 2))
            .withColumn("wow_change_pct", F.round((F.col("_rev") - prev).cast("double") * 100
                                                  / F.when(prev != 0, prev.cast("double")), 1))
            .withColumn("revenue_usd", F.col("_rev").cast("double")).drop("_rev")
            .orderBy(F.col("full_date").desc()).limit(k))


def product_performance(m: Marts, k: int = 15) -> DataFrame:
    """Net revenue, refund and dispute rates per merchant x product."""
    f = m.fact_transactions.filter(F.col("status") == "succeeded")
    p = m.dim_product.select("product_sk", F.col("name").alias("product_name"), "billing_interval")
    mm = m.dim_merchant.select("merchant_sk", F.col("name").alias("merchant_name"))
    n = F.count(F.lit(1))
    return (f.join(p, "product_sk").join(mm, "merchant_sk")
            .groupBy("merchant_name", "product_name", "billing_interval")
            .agg(n.alias("sales"), F.round(F.sum("amount_usd"), 2).cast("double").alias("gross_usd"),
                 F.round(F.sum("net_amount_usd"), 2).cast("double").alias("net_usd"),
                 pct(F.count_if("is_refunded"), n, 1).alias("refund_rate_pct"),
                 pct(F.count_if("is_disputed"), n, 1).alias("dispute_rate_pct"))
            .withColumn("billing", F.coalesce("billing_interval", F.lit("one-off"))).drop("billing_interval")
            .orderBy(F.col("net_usd").desc(), "merchant_name", "product_name").limit(k))


def compliance_monthly(m: Marts, days: int = 90, as_of: Column | None = None) -> DataFrame:
    """Monthly sensitive-access report by role."""
    a = m.fact_audit_events
    d = F.broadcast(m.dim_date.select("date_sk", "full_date", "year", "month"))
    as_of = as_of if as_of is not None else F.to_date(latest(m.v.audit_logs, "created_at"))
    et = F.col("event_type")
    return (a.join(d, "date_sk").filter(F.col("full_date") >= F.date_sub(as_of, days))
            .groupBy("year", "month", "user_role")
            .agg(F.count(F.lit(1)).alias("total_events"), F.count_if("is_sensitive").alias("sensitive_events"),
                 F.count_if(et == "EXPORT").alias("exports"), F.count_if(et == "ERASURE").alias("gdpr_erasures"),
                 F.count_if(et == "LOGIN_FAILED").alias("failed_logins"),
                 F.countDistinct("user_id_hash").alias("distinct_users"))
            .orderBy(F.col("year").desc(), F.col("month").desc(), F.col("sensitive_events").desc(), "user_role"))


def scd2_as_was_as_is(m: Marts) -> DataFrame:
    """Revenue by category as it was at sale time vs as it is now."""
    f = m.fact_transactions.filter(F.col("status") == "succeeded")
    hist = m.dim_merchant.select("merchant_sk", "merchant_id", F.col("category").alias("category_at_transaction_time"))
    curr = m.dim_merchant.filter("is_current").select("merchant_id", F.col("category").alias("category_current"))
    return (f.join(hist, "merchant_sk").join(curr, "merchant_id")
            .filter(F.col("category_at_transaction_time") != F.col("category_current"))
            .groupBy("category_at_transaction_time", "category_current")
            .agg(F.count(F.lit(1)).alias("transactions"),
                 F.round(F.sum("amount_usd"), 2).cast("double").alias("revenue_usd"))
            .orderBy(F.col("revenue_usd").desc()))


def preagg_equality(m: Marts) -> DataFrame:
    """Monthly revenue from the daily aggregate, the fact and the summary must agree."""
    d = F.broadcast(m.dim_date.select("date_sk", "year", "month"))
    a = (m.agg_daily_revenue.join(d, "date_sk").groupBy("year", "month")
         .agg(F.sum("total_amount_usd").alias("revenue_from_agg")))
    f = (m.fact_transactions.filter(F.col("status") == "succeeded").join(d, "date_sk").groupBy("year", "month")
         .agg(F.sum("amount_usd").alias("revenue_from_fact")))
    s = m.mv_monthly_revenue_by_country.groupBy("year", "month").agg(F.sum("revenue_usd").alias("revenue_from_mv"))
    j = a.join(f, ["year", "month"], "full_outer").join(s, ["year", "month"], "full_outer")
    eq = (F.col("revenue_from_agg") == F.col("revenue_from_fact")) & (F.col("revenue_from_fact") == F.col("revenue_from_mv"))
    return j.select("year", "month", *[F.col(c).cast("double").alias(c) for c in
                                        ("revenue_from_agg", "revenue_from_fact", "revenue_from_mv")],
                    F.coalesce(eq, F.lit(False)).alias("all_equal")).orderBy("year", "month")
