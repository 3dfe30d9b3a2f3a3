"""Bindings: the driver's test tables seen as the payment model.

Every view is a deterministic projection of the given tables (orders, customer,
nation, region, supplier, part, lineitem, events), so its size grows with them.
Integer arithmetic on the natural keys replaces the random draws of a simulator;
the same definitions are written independently as DuckDB SQL in ``plans.oracle``.

Scale notes
-----------
* ``tx`` is the only view with a big join (orders x customer on the customer key);
  everything else is a projection of ``tx`` or of ``events`` (no shuffle), or a
  dimension whose size is bounded by construction (nations, currencies, days).
* Lookup lists (currencies, categories, enumerations) are array literals picked
  by index, so they never become a join.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payflow import constants as K
from payflow.functions import add_seconds, pick, risk_action, risk_level

CUR_CODES = [c[0] for c in K.CURRENCIES]
CUR_DECIMALS = [c[2] for c in K.CURRENCIES]
CATEGORIES = [c[0] for c in K.MERCHANT_CATEGORIES]
MCCS = [c[1] for c in K.MERCHANT_CATEGORIES]
MERCHANT_SPLIT_DATE = "1998-07-01"      # day the re-categorized merchants changed category
MERCHANT_CREATED = "1994-12-01"          # merchants exist before the first order


def country_code(nationkey: Column) -> Column:
    return F.concat(F.lit("C"), F.lpad(nationkey.cast("string"), 2, "0"))


class Views:
    """Lazily built payment views over one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A source table; how it is split over tasks is left to the session's file settings."""
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------------------ reference data
    @cached_property
    def countries(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        return (n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
                .select(country_code(F.col("n_nationkey")).alias("country_code"),
                        F.col("n_nationkey").alias("nationkey"),
                        F.col("n_name").alias("name"),
                        F.col("r_name").alias("region"),
                        F.when(F.col("r_name").isin("EUROPE", "AFRICA"), "EU")
                         .when(F.col("r_name") == "AMERICA", "US").otherwise("APAC").alias("data_region"),
                        (F.col("r_name") == "EUROPE").alias("gdpr_applies"),
                        pick(CUR_CODES, F.col("n_nationkey")).alias("currency_code")))

    @cached_property
    def currencies(self) -> DataFrame:
        # JVM-side literal table (no Python worker round trip)
        rows = F.array(*[F.struct(F.lit(code).alias("currency_code"), F.lit(name).alias("name"),
                                  F.lit(dec).cast("int").alias("decimal_places"),
                                  F.lit(Decimal(rate)).cast("decimal(18,8)").alias("base_rate"))
                         for code, name, dec, rate in K.CURRENCIES])
        known = self.countries.select("currency_code").distinct()          # those that the nations use
        return known.join(F.broadcast(self.spark.range(1).select(F.inline(rows))), "currency_code")

    @cached_property
    def fx(self) -> DataFrame:
        """Daily rate per currency for every day that has a transaction.

        rate = base * (1 + (day_of_year % 7) * 0.001), exact in DECIMAL(18,8).
        Size: days x 9 currencies, bounded by the calendar, not by the row count.
        """
        days = self.tx.select(F.to_date("created_at").alias("rate_date")).distinct()
        cur = F.array(*[F.struct(F.lit(code).alias("c"), F.lit(Decimal(rate)).cast("decimal(18,8)").alias("b"))
                        for code, _, _, rate in K.CURRENCIES])
        return (days.select("rate_date", F.explode(cur).alias("cur"))
                .select("rate_date", F.col("cur.c").alias("currency_code"),
                        (F.col("cur.b") * (F.lit(1) + (F.dayofyear("rate_date") % 7) * F.lit(Decimal("0.001"))))
                        .cast("decimal(18,8)").alias("rate_to_usd"),
                        F.lit("derived").alias("source")))

    # ------------------------------------------------------------------ parties
    @cached_property
    def merchants(self) -> DataFrame:
        s = self.table("supplier")
        return s.select(
            F.col("s_suppkey").alias("merchant_id"),
            F.col("s_name").alias("name"),
            country_code(F.col("s_nationkey")).alias("country_code"),
            pick(CATEGORIES, F.col("s_suppkey")).alias("category"),
            pick(MCCS, F.col("s_suppkey")).alias("mcc"),
            F.when(F.col("s_suppkey") % 13 == 12, "inactive").otherwise("active").alias("status"),
            F.lit(MERCHANT_CREATED).cast("timestamp_ntz").alias("created_at"),
            F.lit(MERCHANT_CREATED).cast("timestamp_ntz").alias("updated_at"))

    @cached_property
    def merchant_history(self) -> DataFrame:
        """Merchant snapshots: suppliers with key % 4 = 0 changed category on the split date.

        Rows: (merchant_id, name, category, mcc, country_code, status, snapshot_date).
        The older snapshot carries category element (key + 1) % 9.
        """
        m = self.merchants
        old = (m.filter(F.col("merchant_id") % 4 == 0)
               .withColumn("category", pick(CATEGORIES, F.col("merchant_id") + 1))
               .withColumn("mcc", pick(MCCS, F.col("merchant_id") + 1))
               .withColumn("snapshot_date", F.to_date(F.lit(MERCHANT_CREATED))))
        new = m.withColumn("snapshot_date", F.when(F.col("merchant_id") % 4 == 0,
                                                   F.to_date(F.lit(MERCHANT_SPLIT_DATE)))
                           .otherwise(F.to_date(F.lit(MERCHANT_CREATED))))
        cols = ["merchant_id", "name", "category", "mcc", "country_code", "status", "snapshot_date"]
        return old.select(cols).unionByName(new.select(cols))

    @cached_property
    def customers(self) -> DataFrame:
        c = self.table("customer")
        return c.select(
            F.col("c_custkey").alias("customer_id"),
            F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
            country_code(F.col("c_nationkey")).alias("country_code"),
            F.col("c_nationkey").alias("nationkey"),
            F.col("c_mktsegment").alias("market_segment"),
            F.timestamp_add("DAY", (F.col("c_custkey") % 28).cast("int"),
                            F.lit(MERCHANT_CREATED).cast("timestamp_ntz")).alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("deleted_at"))

    # ------------------------------------------------------------------ transactions
    @cached_property
    def tx(self) -> DataFrame:
        """One payment per order. Ids are the order key; see module doc for the rules."""
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                        "o_orderdate")
        c = self.table("customer").select("c_custkey", "c_nationkey")
        k = F.col("o_orderkey")
        cur_idx = F.col("c_nationkey") % 9
        decimals = pick(CUR_DECIMALS, cur_idx)
        raw_amount = F.col("o_totalprice").cast("decimal(14,2)")
        score = self.score_of(k)
        geo_nation = F.when(k % 17 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
        declined = (F.col("o_orderstatus") == "F") & (k % 4 == 1)
        created = add_seconds(F.col("o_orderdate"), ((k * 7919) % 86400).cast("int"))
        return (o.join(c, o.o_custkey == c.c_custkey)
                .select(
                    k.alias("transaction_id"),
                    (k % 10).alias("merchant_id"),
                    F.col("o_custkey").alias("customer_id"),
                    (F.col("o_custkey") * 2 + k % 2).alias("payment_method_id"),
                    (k % 200).alias("product_id"),
                    F.when(k % 12 == 5, k).alias("subscription_id"),
                    F.when(decimals == 0, F.round(raw_amount, 0).cast("decimal(14,2)"))
                     .otherwise(raw_amount).alias("amount"),
                    pick(CUR_CODES, cur_idx).alias("currency_code"),
                    F.when((score >= 0.85) | declined, "failed").otherwise("succeeded").alias("status"),
                    F.when(score >= 0.85, F.lit("fraudulent"))
                     .when(declined, pick(K.FAILURE_REASONS, k % 5)).alias("failure_reason"),
                    F.concat_ws(".", F.lit("10"), F.col("c_nationkey").cast("string"),
                                (F.col("o_custkey") % 256).cast("string"), (k % 256).cast("string")).alias("ip_address"),
                    country_code(geo_nation).alias("geo_country_code"),
                    country_code(F.col("c_nationkey")).alias("customer_country_code"),
                    F.concat(F.lit("city_"), (F.col("o_custkey") % 50).cast("string")).alias("geo_city"),
                    pick(K.DEVICE_TYPES, k % 3).alias("device_type"),
                    F.concat(F.lit("idem_"), k.cast("string")).alias("idempotency_key"),
                    created.alias("created_at"),
                    created.alias("updated_at")))

    @cached_property
    def tx_as_of(self) -> Column:
        """Latest payment time as a scalar subquery. The time depends only on the order row,
        so it is taken from ``orders`` alone (no join for a max)."""
        o = self.table("orders")
        k = F.col("o_orderkey")
        return o.agg(F.max(add_seconds(F.col("o_orderdate"), ((k * 7919) % 86400).cast("int")))).scalar()

    @staticmethod
    def score_of(k: Column) -> Column:
        """Model score of a transaction: x = (k*37) % 1000, score = (x^3 div 10^5) / 10^4, DECIMAL(5,4)."""
        x = (k * 37) % 1000
        return (((x * x * x) / 100000).cast("long").cast("decimal(9,0)") * F.lit(Decimal("0.0001"))) \
            .cast("decimal(5,4)")

    @cached_property
    def fraud_indicators(self) -> DataFrame:
        """Scored transactions at medium risk or above (score >= 0.30)."""
        t = self.tx.select("transaction_id", "created_at")
        s = self.score_of(F.col("transaction_id"))
        return (t.withColumn("anomaly_score", s)
                .filter(F.col("anomaly_score") >= 0.30)
                .select(F.col("transaction_id").alias("fraud_id"), "transaction_id", "anomaly_score",
                        risk_level(F.col("anomaly_score")).alias("risk_level"),
                        risk_action(F.col("anomaly_score")).alias("action_taken"),
                        F.lit(K.MODEL_VERSION).alias("model_version"),
                        add_seconds(F.col("created_at"), F.lit(1)).alias("flagged_at")))

    @cached_property
    def refunds(self) -> DataFrame:
        t = self.tx
        k = F.col("transaction_id")
        share = F.when(k % 3 == 0, F.lit(Decimal("0.50"))).when(k % 3 == 1, F.lit(Decimal("0.75"))) \
            .otherwise(F.lit(Decimal("1.00")))
        return (t.filter(k % 25 == 3)
                .select(k.alias("refund_id"), "transaction_id",
                        F.round(F.col("amount") * share, 2).cast("decimal(14,2)").alias("amount"),
                        F.lit("requested_by_customer").alias("reason"),
                        F.when(k % 100 == 78, "pending").otherwise("succeeded").alias("status"),
                        F.timestamp_add("DAY", F.lit(5), F.col("created_at")).alias("created_at")))

    @cached_property
    def disputes(self) -> DataFrame:
        t = self.tx
        k = F.col("transaction_id")
        status = pick(K.DISPUTE_STATUSES, (k / 40).cast("long") % 4)
        opened = F.timestamp_add("DAY", F.lit(10), F.col("created_at"))
        return (t.filter(k % 40 == 7)
                .select(k.alias("dispute_id"), "transaction_id", "amount",
                        F.when(k % 2 == 0, "fraudulent").otherwise("product_not_received").alias("reason"),
                        status.alias("status"),
                        F.to_date(F.timestamp_add("DAY", F.lit(21), F.col("created_at"))).alias("evidence_due_by"),
                        opened.alias("opened_at"),
                        F.when(status.isin("won", "lost"), F.timestamp_add("DAY", F.lit(20), opened))
                         .alias("resolved_at")))

    @cached_property
    def payment_methods(self) -> DataFrame:
        """Distinct (customer, slot) instruments seen on transactions."""
        pm = self.tx.select("payment_method_id", "customer_id").distinct()
        i = F.col("payment_method_id")
        ptype = pick(K.PAYMENT_TYPES, i % 3)
        shared = F.col("customer_id") % 10 < 2
        brand = (F.when((ptype == "card") & shared, pick(K.CARD_BRANDS, (F.col("customer_id") / 10).cast("long") % 4))
                 .when(ptype == "card", pick(K.CARD_BRANDS, i % 4))
                 .when(ptype == "wallet", pick(K.WALLET_BRANDS, (i / 3).cast("long") % 3)))
        # customers 10j and 10j+1 share one card (fingerprint fp_s<j>): bounded groups of two
        fingerprint = F.when(ptype == "card", F.when(
            shared,
            F.concat(F.lit("fp_s"), (F.col("customer_id") / 10).cast("long").cast("string")))
            .otherwise(F.concat(F.lit("fp_"), (i + 100000).cast("string"))))
        return pm.select("payment_method_id", "customer_id", ptype.alias("type"), brand.alias("brand"),
                         F.when(ptype == "card", F.lpad((i % 10000).cast("string"), 4, "0")).alias("last4"),
                         F.concat(F.lit("tok_"), i.cast("string")).alias("token"),
                         fingerprint.alias("fingerprint"),
                         (i % 2 == 0).alias("is_default"))

    @cached_property
    def products(self) -> DataFrame:
        p = self.table("part")
        k = F.col("p_partkey")
        return p.select(k.alias("product_id"), (k % 10).alias("merchant_id"), F.col("p_name").alias("name"),
                        F.col("p_retailprice").cast("decimal(14,2)").alias("unit_price"),
                        pick(CUR_CODES, k % 9).alias("currency_code"),
                        F.when(k % 3 == 0, "month").when(k % 3 == 1, "year").alias("billing_interval"),
                        F.lit(True).alias("active"))

    @cached_property
    def subscriptions(self) -> DataFrame:
        t = self.tx.filter(F.col("transaction_id") % 12 == 5)
        s = ((F.col("transaction_id") / 12).cast("long")) % 10
        return t.select(F.col("transaction_id").alias("subscription_id"), "customer_id", "merchant_id",
                        "product_id",
                        F.when(s <= 6, "active").when(s == 7, "past_due").otherwise("canceled").alias("status"),
                        F.to_date("created_at").alias("current_period_start"),
                        F.to_date(F.timestamp_add("MONTH", F.lit(1), F.col("created_at"))).alias("current_period_end"),
                        "created_at")

    @cached_property
    def analyst_reviews(self) -> DataFrame:
        """Analyst verdicts on reviewed / blocked transactions (70 % of them reviewed)."""
        f = self.fraud_indicators
        k = F.col("transaction_id")
        return (f.filter(F.col("action_taken").isin("review", "block") & (k % 10 < 7))
                .select("transaction_id", (k % 3 == 0).alias("is_fraud"),
                        F.timestamp_add("DAY", (k % 5 + 1).cast("int"), F.col("flagged_at")).alias("labeled_at")))

    # ------------------------------------------------------------------ event-derived
    @cached_property
    def audit_logs(self) -> DataFrame:
        e = self.table("events")
        et = F.col("event_type")
        ev = (F.when(et == "view", "SELECT").when(et == "click", "UPDATE").when(et == "purchase", "EXPORT")
              .when(et == "signup", "LOGIN_FAILED").otherwise("ERASURE"))
        return e.select(F.col("event_id").alias("audit_id"), ev.alias("event_type"),
                        F.when(et != "signup", pick(K.AUDIT_TABLES, F.col("user_id"))).alias("table_name"),
                        F.col("event_id").alias("record_id"),
                        F.col("user_id"), pick(K.AUDIT_ROLES, F.col("user_id")).alias("user_role"),
                        F.concat_ws(".", F.lit("192.168"), (F.col("user_id") % 256).cast("string"),
                                    (F.col("event_id") % 256).cast("string")).alias("ip_address"),
                        F.col("ts").alias("created_at"))

    @cached_property
    def access_events(self) -> DataFrame:
        """Audit events as dense as production traffic, for the burst detectors: the month of
        events runs 200 times as fast, and 40 users share one office address."""
        start, office = F.lit(1704067200000000), (F.col("user_id") / 40).cast("long")
        e = self.table("events").filter(F.col("event_type").isin("signup", "purchase"))
        return e.select(F.when(F.col("event_type") == "signup", "LOGIN_FAILED").otherwise("EXPORT").alias("event_type"), "user_id",
                        F.concat_ws(".", F.lit("192.168"), (office / 256).cast("long").cast("string"),
                                    (office % 256).cast("string")).alias("ip_address"),
                        F.timestamp_micros(start + ((F.unix_micros(F.col("ts").cast("timestamp")) - start) / 200).cast("long"))
                        .cast("timestamp_ntz").alias("created_at"))

    @cached_property
    def ip_blocklist(self) -> DataFrame:
        """Blocked networks of three feeds, nested in each other: of nations, of customers' /24, and of the first
        half of some of those."""
        n, c = self.table("nation"), self.table("customer")
        key, nation = F.col("c_custkey"), F.col("c_nationkey")
        net = lambda host, bits: F.concat_ws(".", F.lit("10"), nation.cast("string"), (key % 256).cast("string"), F.lit(f"{host}/{bits}"))
        return (n.filter(F.col("n_nationkey") % 6 == 5)
                .select(F.concat(F.lit("10."), F.col("n_nationkey").cast("string"), F.lit(".0.0/16")).alias("cidr"), F.lit("country").alias("feed"))
                .union(c.filter(key % 61 == 7).select(net(0, 24), F.lit("account")))
                .union(c.filter(key % 122 == 7).select(net(0, 25), F.lit("host"))).distinct())

    @cached_property
    def logs(self) -> DataFrame:
        e = self.table("events")
        et, v = F.col("event_type"), F.col("value")
        k = F.get_json_object("props", "$.k").cast("int")
        return e.select(
            F.col("event_id").alias("log_id"), F.col("ts").alias("timestamp"),
            F.struct(pick(K.LOG_SERVICES, F.col("user_id")).alias("service"),
                     F.when(et == "signup", "audit").otherwise("access").alias("type"),
                     F.when((et == "error") & (v >= 200), "critical").when(et == "error", "error")
                      .when(v > 300, "warning").otherwise("info").alias("severity")).alias("meta"),
            F.concat(et, F.lit(" k="), k.cast("string")).alias("message"),
            F.struct(F.col("user_id").alias("merchant_id"),
                     F.when(et == "error", 500 + F.col("event_id") % 4).otherwise(200).cast("int").alias("http_status"),
                     F.floor(v * 10).cast("int").alias("latency_ms")).alias("metadata"))

    @cached_property
    def session_events(self) -> DataFrame:
        """Flat session events: one row per event with its session key (user x ISO week)."""
        e = self.table("events")
        et = F.col("event_type")
        k = F.get_json_object("props", "$.k").cast("int")
        sid = F.concat(F.col("user_id").cast("string"), F.lit("-"),
                       F.date_format(F.date_trunc("week", F.col("ts")), "yyyyMMdd"))
        return e.select(
            sid.alias("session_id"), F.col("user_id").alias("customer_id"),
            pick(K.DEVICE_TYPES, F.col("user_id")).alias("device_type"),
            F.col("event_id"),
            F.when(et == "view", "page_view").otherwise(et).alias("event"),
            F.when(et == "view", pick(K.FUNNEL_PAGES, k)).alias("page"),
            F.when((et == "click") & (k % 4 != 0), "pay_button").when(et == "click", "link").alias("element"),
            ((et == "purchase") & (k % 5 == 0)).alias("completes"),
            F.col("ts").alias("timestamp"))

    @cached_property
    def sessions(self) -> DataFrame:
        """Session documents (header + counters). Events stay in ``session_events``; the
        nested form is cut into buckets of at most 200 events (see ``marts.bucket_events``)."""
        se = self.session_events
        return (se.groupBy("session_id", "customer_id", "device_type")
                .agg(F.min("timestamp").alias("session_start"), F.max("timestamp").alias("session_end"),
                     F.count(F.lit(1)).alias("event_count"),
                     F.count_if(F.col("element") == "pay_button").alias("pay_clicks"),
                     F.max(F.col("completes").cast("int")).cast("boolean").alias("converted"))
                .withColumn("duration_seconds",
                            ((F.unix_micros(F.col("session_end").cast("timestamp"))
                              - F.unix_micros(F.col("session_start").cast("timestamp"))) / 1000000).cast("long")))

    # ------------------------------------------------------------------ documents
    @cached_property
    def feedback(self) -> DataFrame:
        t = self.tx.filter(F.col("transaction_id") % 7 == 2)
        q = (F.col("transaction_id") / 7).cast("long")
        tags = (F.when(q % 4 == 0, F.array().cast("array<string>"))
                .when(q % 4 == 1, F.array(F.lit("declined")))
                .when(q % 4 == 2, F.array(F.lit("declined"), F.lit("speed")))
                .otherwise(F.array(F.lit("speed"), F.lit("support"), F.lit("checkout"))))
        # denormalized copy of the merchant name; some documents still carry an old name
        name_copy = F.when(F.col("transaction_id") % 29 == 0, F.lit("renamed merchant")) \
            .otherwise(F.concat(F.lit("Supplier#"), F.lpad(F.col("merchant_id").cast("string"), 9, "0")))
        return (t.select(F.col("transaction_id").alias("feedback_id"), "customer_id", "merchant_id",
                        name_copy.alias("merchant_name"),
                        F.col("customer_country_code").alias("country_code"), "transaction_id",
                        F.timestamp_add("DAY", F.lit(2), F.col("created_at")).alias("submitted_at"),
                        F.struct((q % 5 + 1).cast("int").alias("overall")).alias("scores"),
                        (q % 11).cast("int").alias("nps_score"),
                        tags.alias("tags")))
