"""Monitoring and risk-ops jobs: hard rules, drift, fairness, proxy rates, churn features,
volume anomalies, freshness, burst detectors (batch twins of the streaming alerts),
and small calendar / enrichment reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payflow.operators.ranks import global_running_sums

from payflow import constants as K
from payflow.operators.ranges import cidr_range, ipv4_number, narrowest_range
from payflow.operators.tables import stored
from payflow.operators.windows import burst_starts
from payflow.plans.bindings import Views
from payflow.plans.marts import Marts
from payflow.plans.reports_oltp import latest

SANCTIONED_COUNTRIES = ("C12", "C20")     # parameter of the hard rules (countries under sanctions)


def hard_rule_blocks(v: Views, feats: DataFrame, max_per_hour: int = 20,
                     sanctioned: tuple[str, ...] = SANCTIONED_COUNTRIES) -> DataFrame:
    """Payments blocked before scoring: blocklisted card fingerprint (shared across
    customers), address in a blocked network, sanctioned geo country, or more than ``max_per_hour``
    prior attempts in 1 h."""
    pm = v.payment_methods
    blocked_fp = (pm.filter(F.col("fingerprint").isNotNull()).groupBy("fingerprint")
                  .agg(F.countDistinct("customer_id").alias("n")).filter("n >= 2").select("fingerprint"))
    bad_pm = pm.join(blocked_fp, "fingerprint", "left_semi").select("payment_method_id",
                                                                   F.lit(True).alias("_fp"))
    t = (v.tx.select("transaction_id", "payment_method_id", "geo_country_code")
         .join(bad_pm, "payment_method_id", "left")
         .join(blocked_addresses(v).select("transaction_id", F.lit(True).alias("_ip")), "transaction_id", "left")
         .join(feats.select("transaction_id", F.col("features.transactions_last_1h").alias("_v1h")),
               "transaction_id", "left"))
    rule = (F.when(F.col("_fp"), "blocklisted_fingerprint")
            .when(F.col("_ip"), "blocklisted_ip")
            .when(F.col("geo_country_code").isin(*sanctioned), "sanctioned_country")
            .when(F.col("_v1h") > max_per_hour, "velocity"))
    return t.select("transaction_id", rule.alias("rule")).filter(F.col("rule").isNotNull())


def blocked_addresses(v: Views) -> DataFrame:
    """(transaction_id, cidr, feed) of the payments whose address lies in a blocked network, with the narrowest one."""
    lo, hi = cidr_range(F.col("cidr"))
    ranges = v.ip_blocklist.select("cidr", "feed", lo.alias("lo"), hi.alias("hi"))
    points = v.tx.select("transaction_id", ipv4_number(F.col("ip_address")).alias("ip"))
    return narrowest_range(points, ranges, "transaction_id", "ip", ["cidr", "feed"]).drop("ip")


def ip_blocklist_hits(v: Views) -> DataFrame:
    """Payments per blocked network, each counted at its narrowest."""
    return blocked_addresses(v).groupBy("cidr", "feed").agg(F.count(F.lit(1)).alias("payments"))


def hard_rule_summary(v: Views, feats: DataFrame) -> DataFrame:
    return hard_rule_blocks(v, feats).groupBy("rule").agg(F.count(F.lit(1)).alias("blocked"))


DRIFT_FEATURES = ["amount_zscore", "avg_amount_30d", "ip_reputation_score", "transactions_last_24h",
                  "distinct_countries_30d"]


def feature_drift(feats: DataFrame, as_of: Column | None = None, window_days: int = 365, bins: int = 10,
                  psi_limit: float = 0.2, ks_limit: float = 0.1) -> DataFrame:
    """PSI (equal-width bins over the reference range, with one bin below and one above
    it) and exact KS (largest CDF gap over all values) per feature between the reference
    period and the last ``window_days``. Retrain when > 3 features drift.

    Long format (feature, value, period): histograms are partial aggregates; the CDFs are
    distributed running sums over the distinct values (to 9 places).
    """
    as_of = as_of if as_of is not None else latest(feats, "computed_at")
    cur = F.col("computed_at") >= as_of - F.expr(f"INTERVAL {window_days} DAYS")
    long = feats.select(F.when(cur, "cur").otherwise("ref").alias("period"),
                        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
                                                     F.col(f"features.{c}").cast("double").alias("value"))
                                            for c in DRIFT_FEATURES])).alias("f")) \
        .select("period", "f.feature", "f.value").filter(F.col("value").isNotNull())
    rng = long.filter(F.col("period") == "ref").groupBy("feature").agg(F.min("value").alias("lo"),
                                                                       F.max("value").alias("hi"))
    b = long.join(F.broadcast(rng), "feature")          # one row per feature
    width = F.col("hi") - F.col("lo")
    bin_ = (F.when(F.col("value") < F.col("lo"), -1).when(F.col("value") > F.col("hi"), bins).when(width == 0, 0)
            .otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / width * bins), F.lit(bins - 1))))
    # one pass over the rows: counts per distinct value, from which histogram and distribution both follow
    each = stored(b.groupBy("feature", "value", "lo", "hi")
                  .agg(F.count_if(F.col("period") == "ref").alias("r"), F.count_if(F.col("period") == "cur").alias("c")), "drift-values")
    h = each.withColumn("bin", bin_.cast("int")).groupBy("feature", "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    tot = Window.partitionBy("feature")
    eps = 1e-4
    pr = F.greatest(F.col("r") / F.sum("r").over(tot), F.lit(eps))
    pc = F.greatest(F.col("c") / F.sum("c").over(tot), F.lit(eps))
    psi = h.withColumn("t", (pc - pr) * F.log(pc / pr)).groupBy("feature").agg(F.sum("t").alias("psi"))
    d = each.groupBy("feature", F.round("value", 9).alias("value")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    run = global_running_sums(d, ["feature", "value"], {"r": ("run_r", "_r"), "c": ("run_c", "_c")})
    sizes = each.groupBy("feature").agg(F.sum("r").alias("n_r"), F.sum("c").alias("n_c"))     # one row per feature
    earlier = Window.orderBy("feature").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("o_r", F.coalesce(F.sum("n_r").over(earlier), F.lit(0))) \
        .withColumn("o_c", F.coalesce(F.sum("n_c").over(earlier), F.lit(0)))
    gap = F.abs((F.col("run_r") - F.col("o_r")) / F.col("n_r") - (F.col("run_c") - F.col("o_c")) / F.col("n_c"))
    ks = run.join(F.broadcast(sizes), "feature").groupBy("feature").agg(F.max(gap).alias("ks"))
    out = psi.join(ks, "feature").select("feature", F.round("psi", 4).alias("psi"), F.round("ks", 4).alias("ks"),
                                         ((F.col("psi") > psi_limit) | (F.col("ks") > ks_limit)).alias("drifting"))
    n_drift = F.sum(F.col("drifting").cast("int")).over(Window.partitionBy())    # <= 5 rows
    return out.withColumn("retrain_signal", n_drift > 3)


def fairness_block_rate(v: Views, max_ratio: float = 2.0) -> DataFrame:
    """Block rate per device, country and customer segment vs the overall rate; flag ratio > 2."""
    s = Views.score_of(F.col("transaction_id"))
    segment = v.customers.select("customer_id", F.col("market_segment").alias("segment"))
    t = v.tx.join(segment, "customer_id", "left").select("device_type", "geo_country_code", "segment", (s >= 0.85).alias("blocked"))
    overall = t.agg(F.avg(F.col("blocked").cast("double"))).scalar()
    parts = []
    for dim in ("device_type", "geo_country_code", "segment"):
        parts.append(t.groupBy(F.col(dim).alias("value")).agg(F.count(F.lit(1)).alias("n"),
                                                              F.count_if("blocked").alias("blocked"))
                     .withColumn("dimension", F.lit(dim)))
    g = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rate = F.col("blocked") / F.col("n")
    return g.select("dimension", "value", "n", "blocked", F.round(rate * 100, 3).alias("block_rate_pct"),
                    F.round(rate / overall, 4).alias("ratio_to_overall"), (rate / overall > max_ratio).alias("flagged"))


def proxy_rate_alerts(v: Views, tolerance: float = 0.5) -> DataFrame:
    """Daily block / 3DS / review rates and their change vs 7 days before (> 50 % = alert).
    One row per day; the comparison is a join on day - 7 (calendar, not rows)."""
    s = Views.score_of(F.col("transaction_id"))
    from payflow.functions import risk_action
    d = (v.tx.select(F.to_date("created_at").alias("day"), risk_action(s).alias("action"))
         .groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "block").alias("block"),
                             F.count_if(F.col("action") == "challenge_3ds").alias("challenge"),
                             F.count_if(F.col("action") == "review").alias("review")))
    prev = d.select(F.date_add("day", 7).alias("day"), F.col("n").alias("p_n"), F.col("block").alias("p_block"))
    j = d.join(prev, "day", "left")
    r, pr = F.col("block") / F.col("n"), F.col("p_block") / F.col("p_n")
    return j.select("day", "n", F.round(r * 100, 3).alias("block_rate_pct"),
                    F.round(F.col("challenge") / F.col("n") * 100, 3).alias("challenge_rate_pct"),
                    F.round(F.col("review") / F.col("n") * 100, 3).alias("review_rate_pct"),
                    F.round(pr * 100, 3).alias("prev_week_block_rate_pct"),
                    F.coalesce(F.abs(r - pr) > tolerance * pr, F.lit(False)).alias("alert"))


def session_buckets(v: Views, size: int = 200) -> DataFrame:
    return bucket_events(v, size).drop("events")


def merchant_churn_features(m: Marts, as_of: Column | None = None) -> DataFrame:
    """Per merchant (current version): days since last success, 30-day volume and the
    previous 30 days, daily-volume slope over 90 days, refund rate, NPS; churn label =
    no success in the last 30 days."""
    v = m.v
    t = v.tx
    as_of = as_of if as_of is not None else v.tx_as_of
    ok = t.filter(F.col("status") == "succeeded")
    days = F.datediff(F.to_date(as_of), F.to_date("created_at"))
    daily = (ok.filter(days < 90).groupBy("merchant_id", F.to_date("created_at").alias("day"))
             .agg(F.sum("amount").cast("double").alias("vol"))
             .withColumn("x", F.datediff(F.col("day"), F.to_date(as_of)).cast("double")))
    slope = daily.groupBy("merchant_id").agg(F.round(F.regr_slope("vol", "x"), 2).alias("volume_slope_90d"))
    base = ok.groupBy("merchant_id").agg(
        F.max("created_at").alias("last_success"),
        F.sum(F.when(days < 30, F.col("amount")).otherwise(0)).cast("double").alias("volume_30d"),
        F.sum(F.when((days >= 30) & (days < 60), F.col("amount")).otherwise(0)).cast("double").alias("volume_prev_30d"))
    ref = v.refunds.groupBy("transaction_id").agg(F.lit(1).alias("_r"))
    rr = (t.join(ref, "transaction_id", "left").groupBy("merchant_id")
          .agg(F.round(F.avg(F.coalesce("_r", F.lit(0)).cast("double")) * 100, 3).alias("refund_rate_pct")))
    nps = v.feedback.groupBy("merchant_id").agg(
        F.round(F.sum("nps_score").cast("decimal(38,0)") / F.count("nps_score"), 2).cast("double").alias("avg_nps"))
    cur = m.dim_merchant.filter("is_current").select("merchant_sk", "merchant_id")
    return (cur.join(base, "merchant_id").join(slope, "merchant_id", "left").join(rr, "merchant_id", "left")
            .join(nps, "merchant_id", "left")
            .withColumn("days_since_last_success", F.datediff(F.to_date(as_of), F.to_date("last_success")))
            .withColumn("churned", F.col("days_since_last_success") >= 30).drop("last_success"))


def region_volume_anomalies(m: Marts, sigma: float = 3.0, weeks: int = 8) -> DataFrame:
    """Daily payments per region vs the mean / std of the same weekday over the previous
    ``weeks`` weeks (rows of that weekday); |z| > sigma flags an anomaly."""
    f = m.fact_transactions
    d = F.broadcast(m.dim_date.select("date_sk", "full_date", "day_of_week"))
    g = F.broadcast(m.dim_geography.select("geography_sk", "region"))
    daily = (f.join(d, "date_sk").join(g, "geography_sk").groupBy("region", "full_date", "day_of_week")
             .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("region", "day_of_week").orderBy("full_date").rowsBetween(-weeks, -1)
    mu, sd = F.avg("n").over(w), F.stddev_samp("n").over(w)
    z = F.when(F.col("_sd") > 0, (F.col("n") - F.col("_mu")) / F.col("_sd"))
    return (daily.withColumn("_mu", mu).withColumn("_sd", sd)
            .select("region", "full_date", "n", F.round("_mu", 3).alias("baseline"), F.round("_sd", 3).alias("sigma"),
                    F.round(z, 3).alias("z"), F.coalesce(F.abs(z) > sigma, F.lit(False)).alias("anomaly")))


def lag_report(changes: DataFrame) -> DataFrame:
    """Load lag by month of payment: from the payment to the arrival of its last change, over the staged rows of
    the landed messages (``transaction_id, created_at, lsn, ingested_at``)."""
    first = -F.unix_micros(F.col("ingested_at").cast("timestamp"))              # of a replayed change its first arrival
    last = (changes.groupBy("transaction_id")
            .agg(F.max_by(F.struct("created_at", "ingested_at"), F.struct(F.col("lsn"), first)).alias("c")).select("c.*"))
    lag = F.timestamp_diff("SECOND", F.col("created_at"), F.col("ingested_at"))
    return (last.groupBy(F.year("created_at").alias("year"), F.month("created_at").alias("month"))
            .agg(F.count(F.lit(1)).alias("rows"), F.max(lag).alias("max_lag_s"), F.round(F.avg(lag), 3).alias("avg_lag_s"),
                 F.count_if(lag > 100).alias("late_rows")))


def load_recency(loaded: DataFrame, now: Column, most_s: int = 900) -> DataFrame:
    """Age of the newest load (``loaded_at``, see ``sources.readers.with_load_time``) and whether it is recent."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.max("loaded_at"))
    return loaded.agg(F.max("loaded_at").alias("last_load"), age.alias("age_s"), F.coalesce(age <= most_s, F.lit(False)).alias("ok"))


def login_failure_bursts(v: Views, window_s: int = 60, more_than: int = 5) -> DataFrame:
    """K9: more than five failed logins of one address within a minute, each burst once."""
    a = v.access_events.filter(F.col("event_type") == "LOGIN_FAILED")
    return burst_starts(a, ["ip_address"], "created_at", window_s, more_than)


def export_bursts(v: Views, window_s: int = 3600, more_than: int = 3) -> DataFrame:
    """More than three exports of one user within an hour, each burst once."""
    a = v.access_events.filter(F.col("event_type") == "EXPORT")
    return burst_starts(a, ["user_id"], "created_at", window_s, more_than)


def revenue_yoy_quarterly(m: Marts) -> DataFrame:
    """Quarterly revenue and year-over-year change (lag of 4 quarter rows)."""
    f = m.fact_transactions.filter(F.col("status") == "succeeded")
    d = F.broadcast(m.dim_date.select("date_sk", "year", "quarter"))
    q = f.join(d, "date_sk").groupBy("year", "quarter").agg(F.sum("amount_usd").alias("_rev"))
    w = Window.orderBy("year", "quarter")       # one row per quarter: bounded by the calendar
    prev = F.lag("_rev", 4).over(w)
    return q.select("year", "quarter", F.col("_rev").cast("double").alias("revenue_usd"),
                    prev.cast("double").alias("revenue_prev_year_usd"),
                    F.round((F.col("_rev") - prev).cast("double") * 100 / prev.cast("double"), 2).alias("yoy_pct"))


def revenue_by_weekday_hour(m: Marts) -> DataFrame:
    """Revenue by day of week x hour of day from the fact and the calendar."""
    f = m.fact_transactions.filter(F.col("status") == "succeeded")
    d = F.broadcast(m.dim_date.select("date_sk", "day_of_week", "day_name"))
    return (f.join(d, "date_sk").groupBy("day_of_week", "day_name", "hour_of_day")
            .agg(F.count(F.lit(1)).alias("payments"), F.sum("amount_usd").cast("double").alias("revenue_usd")))


def amount_stats_by_currency(v: Views) -> DataFrame:
    """Mean and sample standard deviation of payment amounts per currency."""
    return v.tx.groupBy("currency_code").agg(F.count(F.lit(1)).alias("n"),
                                             F.round(F.avg(F.col("amount").cast("double")), 2).alias("mean_amount"),
                                             F.round(F.stddev_samp(F.col("amount").cast("double")), 2).alias("std_amount"))


def merchants_with_mcc(v: Views) -> DataFrame:
    """MCC -> category enrichment through the fixed code table (broadcast, 9 rows)."""
    codes = v.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(code).alias("mcc"),
                                                                F.lit(cat).alias("mcc_category"))
                                                       for cat, code in K.MERCHANT_CATEGORIES])))
    return v.merchants.select("merchant_id", "name", "mcc").join(F.broadcast(codes), "mcc", "left")


def bucket_events(v: Views, size: int = 200) -> DataFrame:
    """Session events cut into bucket documents of at most ``size`` events.

    The position inside a session is a per-group row number that splits a very long
    session across tasks (``group_row_number``); each gathered bucket holds <= ``size``
    events, so no task ever holds a whole session."""
    from payflow.operators.ranks import group_row_number
    se = v.session_events
    pos = group_row_number(se, ["session_id"], ["timestamp", "event_id"], "pos").withColumn("pos", F.col("pos") - 1)
    return (pos.groupBy("session_id", (F.col("pos") / size).cast("int").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("events_in_bucket"), F.min("timestamp").alias("first_event"),
                 F.max("timestamp").alias("last_event"),
                 F.array_sort(F.collect_list(F.struct("pos", "event", "page", "element"))).alias("events")))
