"""Privacy and compliance jobs: erasure across stores, retention, PAN scan, residency.

Erasure takes the request list as a DataFrame (ids never pass through the driver)
and rewrites each store with a join: ``left_anti`` to delete, a left join flag to
pseudonymize. Facts stay (accounting) but lose their link to the identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payflow.functions import hour_of_day
from payflow.plans.bindings import Views
from payflow.plans.reports_oltp import latest


def erasure_requests(v: Views) -> DataFrame:
    """Requests logged as ERASURE events in the audit trail (one row per customer id)."""
    return (v.audit_logs.filter(F.col("event_type") == "ERASURE")
            .groupBy(F.col("user_id").alias("customer_id")).agg(F.min("created_at").alias("requested_at")))


def _flag(df: DataFrame, ids: DataFrame, key: str = "customer_id") -> DataFrame:
    return df.join(ids.select(key).distinct().withColumn("_erase", F.lit(True)), key, "left") \
        .withColumn("_erase", F.coalesce("_erase", F.lit(False)))


def erase_customers(customers: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """M1: email replaced by a non-identifying placeholder, deletion time set."""
    c = _flag(customers, ids)
    email = F.when(F.col("_erase"), F.concat(F.lit("erased+"), F.md5(F.col("customer_id").cast("string")),
                                             F.lit("@invalid"))).otherwise(F.col("email"))
    return c.withColumn("email", email) \
        .withColumn("deleted_at", F.when(F.col("_erase"), as_of).otherwise(F.col("deleted_at"))).drop("_erase")


def erase_transactions(tx: DataFrame, ids: DataFrame) -> DataFrame:
    """M1: amount, date and merchant stay; IP and city go."""
    t = _flag(tx, ids)
    return (t.withColumn("ip_address", F.when(F.col("_erase"), F.lit(None)).otherwise(F.col("ip_address")))
            .withColumn("geo_city", F.when(F.col("_erase"), F.lit(None)).otherwise(F.col("geo_city")))
            .drop("_erase"))


def erase_payment_methods(pm: DataFrame, tx: DataFrame, ids: DataFrame) -> DataFrame:
    """M1: instruments of erased customers are deleted unless a payment still uses them."""
    used = tx.select("payment_method_id").distinct()
    gone = pm.join(ids.select("customer_id").distinct(), "customer_id", "left_semi") \
        .join(used, "payment_method_id", "left_anti").select("payment_method_id")
    return pm.join(gone, "payment_method_id", "left_anti")


def erasure_audit_rows(ids: DataFrame, as_of: Column) -> DataFrame:
    return ids.select(F.concat(F.lit("aud_erasure_"), F.col("customer_id").cast("string")).alias("audit_id"),
                      F.lit("ERASURE").alias("event_type"), F.lit("customers").alias("table_name"),
                      F.col("customer_id").cast("string").alias("record_id"),
                      F.lit("dag_right_to_erasure").alias("user_id"), F.lit("service").alias("user_role"),
                      as_of.alias("created_at"))


def erase_documents(sessions: DataFrame, feedback: DataFrame, features: DataFrame, ids: DataFrame
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M2: sessions deleted; feedback and feature documents lose the customer id."""
    k = ids.select("customer_id").distinct()
    s = sessions.join(k, "customer_id", "left_anti")
    fb = _flag(feedback, k).withColumn("customer_id", F.when(F.col("_erase"), F.lit(None).cast("long"))
                                       .otherwise(F.col("customer_id"))).drop("_erase")
    ft = _flag(features, k).withColumn("customer_id", F.when(F.col("_erase"), F.lit(None).cast("long"))
                                       .otherwise(F.col("customer_id"))).drop("_erase")
    return s, fb, ft


def erase_star(dim_customer: DataFrame, ids: DataFrame) -> DataFrame:
    """M3: the dimension row loses its identity; facts keep pointing at the anonymous key."""
    d = _flag(dim_customer, ids)
    return (d.withColumn("customer_id", F.when(F.col("_erase"), F.lit(None).cast("long")).otherwise(F.col("customer_id")))
            .withColumn("email_hash", F.when(F.col("_erase"), F.lit(None)).otherwise(F.col("email_hash")))
            .drop("_erase"))


def erasure_residue(ids: DataFrame, stores: dict[str, tuple[DataFrame, DataFrame, str, Column]]) -> DataFrame:
    """M4: rows of erased customers that still identify them, per store (all must be 0).

    ``stores`` maps a name to (rows before, rows after, key, condition). Whose a row was is
    looked up in the rows before the erasure, and found again by a key that the erasure
    keeps, so a column that was left set is seen even where the customer id is gone."""
    k = ids.select("customer_id").distinct()
    out = None
    for name, (before, after, key, still) in stores.items():
        theirs = before.join(k, "customer_id", "left_semi").select(key).distinct()
        found = (after.join(theirs, key, "left_semi").filter(still).agg(F.count(F.lit(1)).alias("residue"))
                 .select(F.lit(name).alias("store"), "residue"))
        out = found if out is None else out.unionByName(found)
    return out


def erased_customers_report(v: Views) -> DataFrame:
    """Registered form of M1 over the whole customers table (all rows, erased ones rewritten)."""
    ids = erasure_requests(v)
    as_of = latest(v.audit_logs, "created_at")
    c = erase_customers(v.customers, ids, as_of)
    return c.select("customer_id", "email", "country_code", "deleted_at")


def erased_stores(v: Views, features: DataFrame, dim_customer: DataFrame) -> dict[str, tuple[DataFrame, DataFrame, str, Column]]:
    """Every store before and after the erasure, as ``erasure_residue`` takes them."""
    ids = erasure_requests(v)
    s, fb, ft = erase_documents(v.sessions, v.feedback, features, ids)
    named = F.col("customer_id").isNotNull()
    return {
        "customers.email": (v.customers, erase_customers(v.customers, ids, latest(v.audit_logs, "created_at")), "customer_id",
                            ~F.col("email").startswith("erased+")),
        "transactions.ip_or_city": (v.tx, erase_transactions(v.tx, ids), "transaction_id",
                                    F.col("ip_address").isNotNull() | F.col("geo_city").isNotNull()),
        "sessions": (v.sessions, s, "session_id", F.lit(True)),
        "feedback.customer_id": (v.feedback, fb, "feedback_id", named),
        "ml_features.customer_id": (features, ft, "transaction_id", named),
        "dim_customer": (dim_customer, erase_star(dim_customer, ids), "customer_sk", named | F.col("email_hash").isNotNull()),
    }


def erasure_residue_report(v: Views, features: DataFrame, dim_customer: DataFrame) -> DataFrame:
    return erasure_residue(erasure_requests(v), erased_stores(v, features, dim_customer))


def erased_payment_methods(v: Views) -> DataFrame:
    """Registered form of M1 for instruments: what stays after the erasure."""
    return erase_payment_methods(v.payment_methods, v.tx, erasure_requests(v)).select("payment_method_id", "customer_id")


def erasure_audit(v: Views) -> DataFrame:
    """Registered form of M1's audit rows: one per erased customer."""
    return erasure_audit_rows(erasure_requests(v), latest(v.audit_logs, "created_at"))


# ----------------------------------------------------------------------------- retention (M6)
def apply_retention(df: DataFrame, ts: str, max_age_days: int, action: str, as_of: Column,
                    id_cols: tuple[str, ...] = ("customer_id",)) -> DataFrame:
    """Delete (``action='delete'``) or anonymize (null the id columns) rows older than the limit."""
    old = F.col(ts) < as_of - F.expr(f"INTERVAL {int(max_age_days)} DAYS")
    if action == "delete":
        return df.filter(~old)
    out = df
    for c in id_cols:
        out = out.withColumn(c, F.when(old, F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return out


def retention_summary(v: Views) -> DataFrame:
    """Rows kept / anonymized per collection under the retention rules
    (logs 90 d delete, sessions 180 d delete, feedback 36 months anonymize)."""
    logs_as_of = latest(v.logs, "timestamp")
    tx_as_of = v.tx_as_of
    logs = apply_retention(v.logs, "timestamp", 90, "delete", logs_as_of)
    sess = apply_retention(v.sessions, "session_start", 180, "delete", latest(v.sessions, "session_start"))
    fb = apply_retention(v.feedback, "submitted_at", 3 * 365, "anonymize", tx_as_of)
    return (logs.agg(F.lit("logs").alias("collection"), F.count(F.lit(1)).alias("rows_kept"),
                     F.lit(0).cast("long").alias("rows_anonymized"))
            .unionByName(sess.agg(F.lit("user_sessions").alias("collection"), F.count(F.lit(1)).alias("rows_kept"),
                                  F.lit(0).cast("long").alias("rows_anonymized")))
            .unionByName(fb.agg(F.lit("customer_feedback").alias("collection"), F.count(F.lit(1)).alias("rows_kept"),
                                F.count_if(F.col("customer_id").isNull()).alias("rows_anonymized"))))


def feature_retention(v: Views, feats: DataFrame) -> DataFrame:
    """The rule of the feature documents (24 months with customer_id, then anonymize; never
    deleted): rows kept / anonymized, and old rows that still name a customer after it (must be 0)."""
    as_of = v.tx_as_of
    after = apply_retention(feats, "computed_at", 2 * 365, "anonymize", as_of)
    old = F.col("computed_at") < as_of - F.expr("INTERVAL 730 DAYS")
    return after.agg(F.lit("ml_features").alias("collection"), F.count(F.lit(1)).alias("rows_kept"),
                     F.count_if(F.col("customer_id").isNull()).alias("rows_anonymized"),
                     F.count_if(old & F.col("customer_id").isNotNull()).alias("overdue_rows"))


# ----------------------------------------------------------------------------- PAN scan (M7)
DIGIT_RUN = r"\d(?:[ -]?\d){12,}"


def find_card_numbers(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Card numbers in free text: 13-19 digits that pass the Luhn check, written in one or more
    groups with single spaces or dashes between. Of a run of digit groups every window of
    consecutive groups is tested, so a card is found beside other numbers. The whole text is
    scanned; one row per (document, number found)."""
    runs = df.select(id_col, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(DIGIT_RUN), 0)).alias("raw"))
    groups = F.split("raw", "[ -]")
    windows = F.flatten(F.transform(F.sequence(F.lit(1), F.size("g")), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(19), F.size("g") - i + 1)), lambda n: F.array_join(F.slice("g", i, n), ""))))
    cands = (runs.select(id_col, groups.alias("g"))
             .select(id_col, F.explode(F.filter(windows, lambda w: F.length(w).between(13, 19))).alias("pan")))
    return (cands.filter(F.call_function("luhn_check", F.col("pan")))
            .select(id_col, F.concat(F.substring("pan", 1, 6), F.lit("******"),
                                     F.substring(F.col("pan"), -4, 4)).alias("masked_pan"),
                    F.length("pan").alias("digits")))


def documents_with_cards(v: Views) -> DataFrame:
    """Per document: number of Luhn-valid card numbers found."""
    return (find_card_numbers(v.table("documents"), "doc_id", "text")
            .groupBy("doc_id").agg(F.count(F.lit(1)).alias("card_numbers"),
                                   F.min("masked_pan").alias("first_masked")))


# ----------------------------------------------------------------------------- residency, access (M8, M9)
def residency_check(dim_customer: DataFrame, countries: DataFrame) -> DataFrame:
    """M8: customers per data region as stored in the dimension, and those stored in another
    region than their country's (must be 0)."""
    want = F.broadcast(countries.select("country_code", F.col("data_region").alias("_want")))     # one row per country
    return (dim_customer.join(want, "country_code", "left").groupBy("data_region")
            .agg(F.count(F.lit(1)).alias("customers"),
                 F.count_if(~F.col("data_region").eqNullSafe(F.col("_want"))).alias("misplaced")))


def split_by_region(df: DataFrame, path: str, region_col: str = "data_region") -> None:
    """M8: one folder per data region below ``path``, so a region's rows can be kept in its own store."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(region_col).parquet(path))


def off_hours_access(v: Views, start_hour: int = 0, end_hour: int = 6) -> DataFrame:
    """M9: human (non-service) access to payment methods between 00:00 and 06:00."""
    a = v.audit_logs
    return (a.filter((F.col("table_name") == "payment_methods") & (F.col("user_role") != "service")
                     & (hour_of_day(F.col("created_at")) >= start_hour) & (hour_of_day(F.col("created_at")) < end_hour))
            .groupBy("user_id", "user_role").agg(F.count(F.lit(1)).alias("events"),
                                                 F.min("created_at").alias("first_event"),
                                                 F.max("created_at").alias("last_event")))


def subject_access_export(v: Views, part_size: int = 1000) -> DataFrame:
    """M5: the data of each requesting customer from every store as JSON documents:
    part 0 holds the profile; payments and feedback follow in parts of at most
    ``part_size`` records (numbered per customer with a row number that splits a very
    active customer across tasks), so no document grows with one customer's history."""
    from payflow.operators.ranks import group_row_number
    req = v.audit_logs.filter(F.col("event_type") == "EXPORT").select(F.col("user_id").alias("customer_id")).distinct()
    c = v.customers.join(req, "customer_id", "left_semi")
    profile = c.select("customer_id", F.lit("profile").alias("store"), F.lit(0).cast("long").alias("part"),
                       F.to_json(F.struct("email", "country_code", "created_at")).alias("export_json"))

    def chunked(df: DataFrame, store: str, order: str, cols: list[str]) -> DataFrame:
        rows = group_row_number(df.join(req, "customer_id", "left_semi"), ["customer_id"], [order], "_rn")
        g = (rows.withColumn("part", ((F.col("_rn") - 1) / part_size).cast("long") + 1)
             .groupBy("customer_id", "part").agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("_r")))
        return g.select("customer_id", F.lit(store).alias("store"), "part",
                        F.to_json(F.struct(F.col("_r").alias(store))).alias("export_json"))

    pay = chunked(v.tx, "payments", "transaction_id", ["amount", "currency_code", "status", "created_at"])
    fb = chunked(v.feedback, "feedback", "feedback_id", ["nps_score", "submitted_at"])
    return profile.unionByName(pay).unionByName(fb)


# ----------------------------------------------------------------------------- M10-M14
def exclude_opted_out(df: DataFrame, opt_outs: DataFrame, key: str = "customer_id") -> DataFrame:
    """Drop customers who opted out of personalization (anti join)."""
    return df.join(opt_outs.select(key).distinct(), key, "left_anti")


def grants_diff(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Grants present but not expected ('excess') and expected but missing ('missing')."""
    excess = actual.join(expected, keys, "left_anti").select(*keys).withColumn("diff", F.lit("excess"))
    missing = expected.join(actual, keys, "left_anti").select(*keys).withColumn("diff", F.lit("missing"))
    return excess.unionByName(missing)


def overdue_requests(v: Views, deadline_days: int = 3, as_of: Column | None = None) -> DataFrame:
    """Privacy requests (erasure / export events in the audit trail) open past the
    deadline at ``as_of``: the internal objective is 72 h (the legal limit, 30 days, is
    the same report with ``deadline_days=30``)."""
    a = v.audit_logs
    as_of = as_of if as_of is not None else latest(a, "created_at")
    req = (a.filter(F.col("event_type").isin("ERASURE", "EXPORT"))
           .groupBy(F.col("user_id").alias("customer_id"), F.col("event_type").alias("request_type"))
           .agg(F.min("created_at").alias("requested_at")))
    due = F.timestamp_add("DAY", F.lit(deadline_days), F.col("requested_at"))
    return (req.withColumn("due_at", due)
            .withColumn("days_open", F.datediff(F.to_date(as_of), F.to_date("requested_at")))
            .filter(F.col("due_at") < as_of))


def archive_compliance(report: DataFrame, checks: DataFrame, base: str, month: str) -> None:
    """Monthly compliance archive: the report and the check results under ``run_date``."""
    from payflow.sources.sinks import archive_run
    archive_run(report, f"{base.rstrip('/')}/report", month)
    archive_run(checks, f"{base.rstrip('/')}/checks", month)


PII_NAME = r"(?i)(email|e_mail|ip_address|phone|card_number|pan)$"


def pii_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """For every string column of every table: whether its name marks personal data,
    and how many values look like an email (LIKE '%@%'). Names come from the schemas;
    the counts are one aggregate pass per table."""
    import re
    parts = []
    for tname, df in tables.items():
        cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        if not cols:
            continue
        agg = df.agg(*[F.count_if(F.col(c).like("%@%")).alias(c) for c in cols])
        arr = F.array(*[F.struct(F.lit(tname).alias("table"), F.lit(c).alias("column"),
                                 F.lit(bool(re.search(PII_NAME, c))).alias("pii_name"),
                                 F.col(c).alias("email_like_values")) for c in cols])
        parts.append(agg.select(F.inline(arr)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
