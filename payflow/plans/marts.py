"""Star schema marts: dimensions, enrichment, fact, pre-aggregates (one Spark plan each).

Join strategy (checked sizes):
* dimensions bounded by construction (geography <= nations, currency = 9 rows,
  payment-method combos <= 8, calendar = days, fx = days x 9) carry a broadcast hint;
* dimensions that grow with the data (customers, merchants, products, payment
  instruments) get no hint: the planner broadcasts them only below
  ``spark.sql.autoBroadcastJoinThreshold`` (and AQE re-plans from runtime sizes),
  otherwise they are sort-merge joined; AQE's skew-join splits a hot merchant key.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payflow import constants as K
from payflow.functions import date_sk, ip_to_24, salted_sha256, short_sha256, surrogate_md5, year_month_of_sk
from payflow.operators.ranks import dense_key, rank_deciles
from payflow.operators.scd2 import scd2_as_of, versions_from_snapshots
from payflow.operators.tables import stored
from payflow.plans.bindings import Views


def small_key(df: DataFrame, order: list, name: str) -> DataFrame:
    """Dense numbering of a dimension whose size is bounded by construction (nations,
    payment-method combinations): a single-partition window over a few dozen rows."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("int"))


def segment_of(decile: Column) -> Column:
    """Deciles 9-10 high_value, 5-8 mid_value, else low_value."""
    return (F.when(decile >= 9, "high_value").when(decile >= 5, "mid_value").otherwise("low_value"))


class Marts:
    """Star schema built from the payment views."""

    def __init__(self, views: Views, merchant_on_miss: str = "latest"):
        self.v = views
        self.merchant_on_miss = merchant_on_miss

    # ------------------------------------------------------------------ dimensions
    @cached_property
    def dim_date(self) -> DataFrame:
        """Calendar padded 31 days on each side of the transaction and audit dates."""
        # payments fall on their order day; audit events are the event times: the span comes
        # from the two source calendars directly (no join needed for a min / max)
        ts = (self.v.table("orders").select(F.col("o_orderdate").alias("ts"))
              .unionByName(self.v.table("events").select(F.col("ts"))))
        span = ts.agg(F.date_sub(F.to_date(F.min("ts")), 31).alias("lo"),
                      F.date_add(F.to_date(F.max("ts")), 31).alias("hi"))
        d = F.col("full_date")
        dow = (F.dayofweek(d) + 5) % 7 + 1            # Monday = 1 .. Sunday = 7
        return (span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("full_date"))
                .select(date_sk(d).alias("date_sk"), d,
                        F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
                        F.date_format(d, "MMMM").alias("month_name"), F.weekofyear(d).alias("week_of_year"),
                        F.dayofmonth(d).alias("day"), dow.alias("day_of_week"),
                        F.date_format(d, "EEEE").alias("day_name"), (dow >= 6).alias("is_weekend"),
                        (((F.month(d) == 1) & (F.dayofmonth(d) == 1)) |
                         ((F.month(d) == 12) & (F.dayofmonth(d) == 25))).alias("is_holiday"),
                        F.year(d).alias("fiscal_year"), F.quarter(d).alias("fiscal_quarter")))

    @cached_property
    def dim_geography(self) -> DataFrame:
        c = self.v.countries
        return small_key(c, ["country_code"], "geography_sk").select(
            "geography_sk", "country_code", F.col("name").alias("country_name"), "region", "data_region",
            "gdpr_applies")

    @cached_property
    def dim_currency(self) -> DataFrame:
        cur = self.v.currencies
        pos = F.array_position(F.array(*[F.lit(c[0]) for c in K.CURRENCIES]), F.col("currency_code"))
        return cur.select(pos.cast("int").alias("currency_sk"), "currency_code", "name", "decimal_places")

    @cached_property
    def dim_payment_method(self) -> DataFrame:
        combos = self.v.payment_methods.select("type", "brand").distinct()
        return small_key(combos, ["type", F.coalesce(F.col("brand"), F.lit(""))], "payment_method_sk").select(
            "payment_method_sk", "type", "brand", (F.col("type") == "wallet").alias("is_digital"))

    @cached_property
    def dim_product(self) -> DataFrame:
        return dense_key(self.v.products, ["product_id"], "product_sk").select(
            "product_sk", "product_id", "merchant_id", "name", "billing_interval", "unit_price", "currency_code")

    @cached_property
    def dim_merchant(self) -> DataFrame:
        """SCD2 on (name, category, country_code, status) from dated merchant snapshots."""
        versions = versions_from_snapshots(self.v.merchant_history, "merchant_id",
                                           ["name", "category", "country_code", "status"], "snapshot_date")
        geo = F.broadcast(self.v.countries.select("country_code", "region"))
        v = versions.join(geo, "country_code", "left")
        return dense_key(v, ["merchant_id", "scd_start"], "merchant_sk").select(
            "merchant_sk", "merchant_id", "name", "category", "mcc", "country_code", "region", "status",
            "scd_start", "scd_end", "is_current")

    @cached_property
    def dim_customer_base(self) -> DataFrame:
        """Pseudonymized customers, one version each; the segment is added after the fact."""
        c = self.v.customers
        geo = F.broadcast(self.v.countries.select("country_code", "region", "data_region"))
        base = c.join(geo, "country_code", "left").select(
            "customer_id", salted_sha256(F.col("email")).alias("email_hash"), "country_code", "region",
            "data_region", F.trunc("created_at", "month").alias("acquisition_month"),
            F.to_date("created_at").alias("scd_start"), F.lit(None).cast("date").alias("scd_end"),
            F.lit(True).alias("is_current"))
        return dense_key(base, ["customer_id"], "customer_sk")

    @cached_property
    def customer_segments(self) -> DataFrame:
        """Segment from deciles of succeeded USD spend (rank 'first' on (spend, key))."""
        spend = (self.fact_transactions.filter(F.col("status") == "succeeded")
                 .groupBy("customer_sk").agg(F.sum("amount_usd").alias("spend")))
        ranked = rank_deciles(spend, ["spend", "customer_sk"], 10, "decile")
        return ranked.select("customer_sk", "spend", "decile", segment_of(F.col("decile")).alias("segment"))

    @cached_property
    def dim_customer(self) -> DataFrame:
        seg = self.customer_segments.select("customer_sk", "segment")
        return (self.dim_customer_base.join(seg, "customer_sk", "left")
                .withColumn("segment", F.coalesce("segment", F.lit("low_value")))
                .select("customer_sk", "customer_id", "email_hash", "country_code", "region", "data_region",
                        "segment", "acquisition_month", "scd_start", "scd_end", "is_current"))

    # ------------------------------------------------------------------ enrichment + fact
    def _in_use(self, dim: DataFrame, key: str) -> DataFrame:
        """The rows of ``dim`` whose key some payment has, written once so that the planner knows their size."""
        return stored(dim.join(self.v.tx.select(key).distinct(), key, "left_semi"), f"used-{key}")

    @cached_property
    def enriched(self) -> DataFrame:
        """USD at the day rate, fee 2.9 % + 0.30 from unrounded USD, refunds, disputes, fraud."""
        v = self.v
        tx = v.tx.withColumn("tx_date", F.to_date("created_at"))
        fx = F.broadcast(v.fx.select("rate_date", "currency_code", "rate_to_usd"))   # days x 9 rows
        refunds = (v.refunds.filter(F.col("status") == "succeeded")
                   .groupBy("transaction_id").agg(F.sum("amount").cast("decimal(16,2)").alias("refund_amount")))
        disputes = v.disputes.select("transaction_id").distinct().withColumn("_disp", F.lit(True))
        fraud = v.fraud_indicators.select("transaction_id", "anomaly_score", "risk_level")
        usd_raw = F.col("amount") * F.col("rate_to_usd")
        ok = F.col("status") == "succeeded"
        zero = F.lit(Decimal("0.00")).cast("decimal(16,2)")
        return (tx.join(fx, (tx.currency_code == fx.currency_code) & (tx.tx_date == fx.rate_date), "left")
                .drop(fx.currency_code)
                .join(refunds, "transaction_id", "left")
                .join(disputes, "transaction_id", "left")
                .join(fraud, "transaction_id", "left")
                .select(*[F.col(c) for c in v.tx.columns], "tx_date",
                        F.round(usd_raw, 2).cast("decimal(16,2)").alias("amount_usd"),
                        F.when(ok, F.round(usd_raw * F.lit(Decimal(K.FEE_PCT)) + F.lit(Decimal(K.FEE_FIXED_USD)), 2))
                         .otherwise(0).cast("decimal(16,2)").alias("fee_usd"),
                        F.coalesce(F.round(F.col("refund_amount") * F.col("rate_to_usd"), 2).cast("decimal(16,2)"),
                                   zero).alias("refund_amount_usd"),
                        F.col("refund_amount").isNotNull().alias("is_refunded"),
                        F.col("_disp").isNotNull().alias("is_disputed"),
                        F.coalesce(F.col("risk_level").isin("high", "critical"), F.lit(False)).alias("is_fraud_flagged"),
                        F.col("subscription_id").isNotNull().alias("is_subscription"),
                        "anomaly_score", "risk_level"))

    @cached_property
    def fact_transactions(self) -> DataFrame:
        """One row per transaction with all surrogate keys resolved (SCD2 as of the day)."""
        e = self.enriched
        pm = self.v.payment_methods.select(F.col("payment_method_id").alias("_pm"), F.col("customer_id").alias("_owner"), "type", "brand")
        dpm = F.broadcast(self.dim_payment_method.select("payment_method_sk", F.col("type").alias("_t"),
                                                         F.col("brand").alias("_b")))
        geo = F.broadcast(self.dim_geography.select("geography_sk", F.col("country_code").alias("geo_country_code")))
        cur = F.broadcast(self.dim_currency.select("currency_sk", "currency_code"))
        # dimensions that many rows share few keys of, cut to the keys in use: small ones are broadcast, whatever the table's size
        prod = self._in_use(self.dim_product.select("product_sk", "product_id"), "product_id")
        merchants = self._in_use(self.dim_merchant, "merchant_id")
        at = F.col("tx_date")
        f = scd2_as_of(e, merchants, "merchant_id", at, ["merchant_sk"], on_miss=self.merchant_on_miss)
        f = scd2_as_of(f, self.dim_customer_base, "customer_id", at, ["customer_sk"], on_miss="drop")
        f = (f.join(geo, "geo_country_code")
             # an instrument is its customer's: rows are by customer already, and only one customer's instruments are looked through
             .join(pm, (F.col("customer_id") == F.col("_owner")) & (F.col("payment_method_id") >= F.col("_pm"))
                   & (F.col("payment_method_id") <= F.col("_pm")))
             .join(dpm, (F.col("type") == F.col("_t")) & F.col("brand").eqNullSafe(F.col("_b")))
             .join(prod, "product_id", "left")
             .join(cur, "currency_code"))
        ok = F.col("status") == "succeeded"
        return f.select(
            "transaction_id", surrogate_md5(F.col("transaction_id")).alias("transaction_sk"),
            date_sk(F.col("created_at")).alias("date_sk"),
            F.hour("created_at").cast("smallint").alias("hour_of_day"),
            "merchant_sk", "customer_sk", "geography_sk", "payment_method_sk", "product_sk", "currency_sk",
            "status", "amount", "amount_usd", "fee_usd",
            F.when(ok, F.col("amount_usd") - F.col("fee_usd") - F.col("refund_amount_usd"))
             .otherwise(0).cast("decimal(16,2)").alias("net_amount_usd"),
            "refund_amount_usd", "is_refunded", "is_disputed", "is_fraud_flagged", "is_subscription",
            "anomaly_score", "risk_level", "device_type", "created_at",
            F.timestamp_add("MINUTE", F.lit(2), F.col("created_at")).alias("loaded_at"))

    @cached_property
    def fact_audit_events(self) -> DataFrame:
        a = self.v.audit_logs
        return a.select(
            F.col("audit_id").alias("audit_sk"), "audit_id", date_sk(F.col("created_at")).alias("date_sk"),
            "event_type", "table_name", "user_role", short_sha256(F.col("user_id")).alias("user_id_hash"),
            (F.coalesce(F.col("table_name").isin(*K.SENSITIVE_TABLES), F.lit(False))
             | F.col("event_type").isin(*K.SENSITIVE_EVENTS)).alias("is_sensitive"))

    # ------------------------------------------------------------------ pre-aggregates
    @cached_property
    def agg_daily_revenue(self) -> DataFrame:
        f = self.fact_transactions.join(F.broadcast(self.dim_currency.select("currency_sk", "currency_code")),
                                        "currency_sk")
        ok = F.col("status") == "succeeded"
        return (f.groupBy("date_sk", "merchant_sk", "currency_code").agg(
            F.count(F.lit(1)).cast("int").alias("transaction_count"),
            F.count_if(ok).cast("int").alias("succeeded_count"),
            F.count_if(F.col("status") == "failed").cast("int").alias("failed_count"),
            F.sum(F.when(ok, F.col("amount")).otherwise(0)).cast("decimal(16,2)").alias("total_amount"),
            F.sum(F.when(ok, F.col("amount_usd")).otherwise(0)).cast("decimal(16,2)").alias("total_amount_usd"),
            F.sum("net_amount_usd").cast("decimal(16,2)").alias("net_amount_usd"),
            F.count_if("is_refunded").cast("int").alias("refund_count"),
            F.count_if("is_disputed").cast("int").alias("dispute_count"),
            F.count_if("is_fraud_flagged").cast("int").alias("fraud_count")))

    @cached_property
    def agg_monthly_fraud(self) -> DataFrame:
        f = self.fact_transactions.withColumn("year_month", year_month_of_sk(F.col("date_sk")))
        return (f.groupBy("year_month", "geography_sk").agg(
            F.count(F.lit(1)).cast("int").alias("total_transactions"),
            F.count_if("is_fraud_flagged").cast("int").alias("total_flagged"),
            F.count_if(F.col("risk_level") == "critical").cast("int").alias("total_critical"),
            F.count_if("is_disputed").cast("int").alias("total_disputed"),
            F.round(F.avg("anomaly_score"), 4).cast("decimal(5,4)").alias("avg_anomaly_score"))
            .withColumn("fraud_rate_pct", F.round(F.col("total_flagged") * F.lit(Decimal("100.0"))
                                                  / F.col("total_transactions"), 3).cast("decimal(6,3)")))

    @cached_property
    def mv_monthly_revenue_by_country(self) -> DataFrame:
        f = self.fact_transactions
        d = F.broadcast(self.dim_date.select("date_sk", "year", "month"))
        g = F.broadcast(self.dim_geography.select("geography_sk", "country_code", "region"))
        ok = F.col("status") == "succeeded"
        return (f.join(d, "date_sk").join(g, "geography_sk")
                .groupBy("year", "month", "country_code", "region").agg(
                    F.count(F.lit(1)).alias("transaction_count"),
                    F.sum(F.when(ok, F.col("amount_usd")).otherwise(0)).cast("decimal(18,2)").alias("revenue_usd"),
                    F.sum("net_amount_usd").cast("decimal(18,2)").alias("net_revenue_usd"),
                    F.count_if("is_fraud_flagged").alias("fraud_count")))

    # ------------------------------------------------------------------ analyst view
    def analyst_view(self) -> DataFrame:
        """Pseudonymized transactions: no email, IP cut to /24."""
        t = self.v.tx
        return t.select("transaction_id", "merchant_id", "customer_id", "amount", "currency_code", "status",
                        "failure_reason", ip_to_24(F.col("ip_address")).alias("ip_network"),
                        "geo_country_code", "device_type", "created_at")
