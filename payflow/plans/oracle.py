"""DuckDB twins of the jobs, for the correctness gate.

Written independently of the Spark code: the bindings, marts and reports are
restated as plain SQL over the same parquet tables (pre-registered views
``orders``, ``customer``, ...). Every query is ``WITH <all views> <query>``;
unused CTEs cost nothing.

Portable-typing rules used throughout: money results are rounded decimals cast to
DOUBLE; averages of money are ``ROUND(CAST(SUM(x) AS DOUBLE) / COUNT(x), 2)``;
counts are BIGINT; averages of DECIMAL(5,4) scores are rounded exactly with integer
arithmetic (DuckDB's decimal AVG returns DOUBLE).
"""

from __future__ import annotations

from payflow import constants as K

CODES = [c[0] for c in K.CURRENCIES]
DECS = [c[2] for c in K.CURRENCIES]
CATS = [c[0] for c in K.MERCHANT_CATEGORIES]
MCCS = [c[1] for c in K.MERCHANT_CATEGORIES]


def _lst(xs) -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in xs) + "]"


def _pick(xs, idx: str) -> str:
    return f"list_extract({_lst(xs)}, CAST(({idx}) % {len(xs)} AS INTEGER) + 1)"


def _cc(nk: str) -> str:
    return f"('C' || lpad(CAST({nk} AS VARCHAR), 2, '0'))"


def _score(k: str) -> str:
    x = f"(({k} * 37) % 1000)"
    return f"CAST(CAST(({x} * {x} * {x}) // 100000 AS DECIMAL(9,0)) * 0.0001 AS DECIMAL(5,4))"


def _risk(p: str) -> str:
    return (f"CASE WHEN {p} < 0.30 THEN 'low' WHEN {p} < 0.60 THEN 'medium' "
            f"WHEN {p} < 0.85 THEN 'high' ELSE 'critical' END")


def _action(p: str) -> str:
    return (f"CASE WHEN {p} < 0.30 THEN 'allow' WHEN {p} < 0.60 THEN 'challenge_3ds' "
            f"WHEN {p} < 0.85 THEN 'review' ELSE 'block' END")


def _avg4(col: str) -> str:
    """Exact half-up rounding of the mean of a DECIMAL(5,4) column to 4 places, as DOUBLE."""
    s = f"SUM(CAST(ROUND({col} * 10000) AS BIGINT))"
    n = f"COUNT({col})"
    return f"(CASE WHEN {n} = 0 THEN NULL ELSE ((2 * {s} + {n}) // (2 * {n})) / 10000.0 END)"


def avg_round(col: str, scale_in: int, out: int = 2) -> str:
    """AVG(col) rounded half-up to ``out`` places, exactly (integer arithmetic on the
    unscaled decimal sum), returned as DOUBLE. Non-negative values assumed."""
    t = f"SUM(CAST({col} * {10 ** scale_in} AS HUGEINT))"
    n = f"CAST(COUNT({col}) AS HUGEINT)"
    num = f"(2 * {t} * {10 ** out} + {n} * {10 ** scale_in})"
    den = f"(2 * {n} * {10 ** scale_in})"
    return f"(CASE WHEN COUNT({col}) = 0 THEN NULL ELSE CAST({num} // {den} AS DOUBLE) / {10 ** out} END)"


def avg_of(total: str, n: str, scale_in: int, out: int = 2) -> str:
    """``avg_round`` from a DECIMAL sum and a count that are already there."""
    t, k = f"CAST({total} * {10 ** scale_in} AS HUGEINT)", f"CAST({n} AS HUGEINT)"
    return f"(CAST((2 * {t} * {10 ** out} + {k} * {10 ** scale_in}) // (2 * {k} * {10 ** scale_in}) AS DOUBLE) / {10 ** out})"


CUR_VALUES = ", ".join(f"('{c}', '{n}', {d}, CAST({r} AS DECIMAL(18,8)), {i + 1})"
                       for i, (c, n, d, r) in enumerate(K.CURRENCIES))
SCORE = _score("o.o_orderkey")

VIEWS = f"""
countries AS (
  SELECT {_cc('n.n_nationkey')} AS country_code, n.n_nationkey AS nationkey, n.n_name AS name,
         r.r_name AS region,
         CASE WHEN r.r_name IN ('EUROPE', 'AFRICA') THEN 'EU' WHEN r.r_name = 'AMERICA' THEN 'US' ELSE 'APAC' END
           AS data_region,
         r.r_name = 'EUROPE' AS gdpr_applies
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
currencies AS (
  SELECT * FROM (VALUES {CUR_VALUES}) t(currency_code, name, decimal_places, base_rate, pos)
  WHERE pos - 1 IN (SELECT n_nationkey % {len(K.CURRENCIES)} FROM nation)),
tx AS (
  SELECT o.o_orderkey AS transaction_id, o.o_orderkey % 10 AS merchant_id, o.o_custkey AS customer_id,
         o.o_custkey * 2 + o.o_orderkey % 2 AS payment_method_id, o.o_orderkey % 200 AS product_id,
         CASE WHEN o.o_orderkey % 12 = 5 THEN o.o_orderkey END AS subscription_id,
         CASE WHEN {_pick(DECS, 'c.c_nationkey')} = 0
              THEN CAST(ROUND(CAST(o.o_totalprice AS DECIMAL(14,2)), 0) AS DECIMAL(14,2))
              ELSE CAST(o.o_totalprice AS DECIMAL(14,2)) END AS amount,
         {_pick(CODES, 'c.c_nationkey')} AS currency_code,
         CASE WHEN {SCORE} >= 0.85 OR (o.o_orderstatus = 'F' AND o.o_orderkey % 4 = 1)
              THEN 'failed' ELSE 'succeeded' END AS status,
         CASE WHEN {SCORE} >= 0.85 THEN 'fraudulent'
              WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 4 = 1 THEN {_pick(K.FAILURE_REASONS, 'o.o_orderkey')}
         END AS failure_reason,
         '10.' || CAST(c.c_nationkey AS VARCHAR) || '.' || CAST(o.o_custkey % 256 AS VARCHAR) || '.'
           || CAST(o.o_orderkey % 256 AS VARCHAR) AS ip_address,
         {_cc('CASE WHEN o.o_orderkey % 17 = 0 THEN (c.c_nationkey + 1) % 25 ELSE c.c_nationkey END')}
           AS geo_country_code,
         {_cc('c.c_nationkey')} AS customer_country_code,
         'city_' || CAST(o.o_custkey % 50 AS VARCHAR) AS geo_city,
         {_pick(K.DEVICE_TYPES, 'o.o_orderkey')} AS device_type,
         'idem_' || CAST(o.o_orderkey AS VARCHAR) AS idempotency_key,
         o.o_orderdate + to_seconds((o.o_orderkey * 7919) % 86400) AS created_at,
         o.o_orderdate + to_seconds((o.o_orderkey * 7919) % 86400) AS updated_at
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
tx_days AS (SELECT DISTINCT CAST(created_at AS DATE) AS rate_date FROM tx),
fx AS (
  SELECT d.rate_date, c.currency_code,
         CAST(c.base_rate * (1 + (dayofyear(d.rate_date) % 7) * 0.001) AS DECIMAL(18,8)) AS rate_to_usd
  FROM tx_days d, currencies c),
merchants AS (
  SELECT s_suppkey AS merchant_id, s_name AS name, {_cc('s_nationkey')} AS country_code,
         {_pick(CATS, 's_suppkey')} AS category, {_pick(MCCS, 's_suppkey')} AS mcc,
         CASE WHEN s_suppkey % 13 = 12 THEN 'inactive' ELSE 'active' END AS status
  FROM supplier),
merchant_history AS (
  SELECT merchant_id, name, {_pick(CATS, 'merchant_id + 1')} AS category, {_pick(MCCS, 'merchant_id + 1')} AS mcc,
         country_code, status, DATE '1994-12-01' AS snapshot_date
  FROM merchants WHERE merchant_id % 4 = 0
  UNION ALL
  SELECT merchant_id, name, category, mcc, country_code, status,
         CASE WHEN merchant_id % 4 = 0 THEN DATE '1998-07-01' ELSE DATE '1994-12-01' END
  FROM merchants),
customers AS (
  SELECT c_custkey AS customer_id, lower(replace(c_name, '#', '.')) || '@example.com' AS email,
         {_cc('c_nationkey')} AS country_code,
         TIMESTAMP '1994-12-01' + to_days(CAST(c_custkey % 28 AS INTEGER)) AS created_at
  FROM customer),
fraud_indicators AS (
  SELECT transaction_id AS fraud_id, transaction_id, s AS anomaly_score, {_risk('s')} AS risk_level,
         {_action('s')} AS action_taken, '{K.MODEL_VERSION}' AS model_version,
         created_at + INTERVAL 1 SECOND AS flagged_at
  FROM (SELECT transaction_id, created_at, {_score('transaction_id')} AS s FROM tx) WHERE s >= 0.30),
refunds AS (
  SELECT transaction_id AS refund_id, transaction_id,
         CAST(ROUND(amount * CASE transaction_id % 3 WHEN 0 THEN 0.50 WHEN 1 THEN 0.75 ELSE 1.00 END, 2)
              AS DECIMAL(14,2)) AS amount,
         CASE WHEN transaction_id % 100 = 78 THEN 'pending' ELSE 'succeeded' END AS status,
         created_at + INTERVAL 5 DAY AS created_at
  FROM tx WHERE transaction_id % 25 = 3),
disputes AS (
  SELECT transaction_id AS dispute_id, transaction_id, amount, st AS status,
         created_at + INTERVAL 10 DAY AS opened_at,
         CASE WHEN st IN ('won', 'lost') THEN created_at + INTERVAL 30 DAY END AS resolved_at
  FROM (SELECT *, {_pick(K.DISPUTE_STATUSES, 'transaction_id // 40')} AS st FROM tx WHERE transaction_id % 40 = 7)),
pm_ids AS (SELECT DISTINCT payment_method_id, customer_id FROM tx),
payment_methods AS (
  SELECT payment_method_id, customer_id, ptype AS type,
         CASE WHEN ptype = 'card' AND customer_id % 10 < 2 THEN {_pick(K.CARD_BRANDS, 'customer_id // 10')}
              WHEN ptype = 'card' THEN {_pick(K.CARD_BRANDS, 'payment_method_id')}
              WHEN ptype = 'wallet' THEN {_pick(K.WALLET_BRANDS, 'payment_method_id // 3')} END AS brand,
         CASE WHEN ptype = 'card' AND customer_id % 10 < 2 THEN 'fp_s' || CAST(customer_id // 10 AS VARCHAR)
              WHEN ptype = 'card' THEN 'fp_' || CAST(payment_method_id + 100000 AS VARCHAR) END AS fingerprint
  FROM (SELECT *, {_pick(K.PAYMENT_TYPES, 'payment_method_id')} AS ptype FROM pm_ids)),
products AS (
  SELECT p_partkey AS product_id, p_partkey % 10 AS merchant_id, p_name AS name,
         CAST(p_retailprice AS DECIMAL(14,2)) AS unit_price, {_pick(CODES, 'p_partkey')} AS currency_code,
         CASE p_partkey % 3 WHEN 0 THEN 'month' WHEN 1 THEN 'year' END AS billing_interval
  FROM part),
subscriptions AS (
  SELECT transaction_id AS subscription_id, customer_id, merchant_id, product_id,
         CASE WHEN (transaction_id // 12) % 10 <= 6 THEN 'active' WHEN (transaction_id // 12) % 10 = 7 THEN 'past_due'
              ELSE 'canceled' END AS status,
         created_at::DATE AS period_start, (created_at + INTERVAL 1 MONTH)::DATE AS period_end
  FROM tx WHERE transaction_id % 12 = 5),
analyst_reviews AS (
  SELECT transaction_id, transaction_id % 3 = 0 AS is_fraud,
         flagged_at + to_days(CAST(transaction_id % 5 + 1 AS INTEGER)) AS labeled_at
  FROM fraud_indicators WHERE action_taken IN ('review', 'block') AND transaction_id % 10 < 7),
audit_logs AS (
  SELECT event_id AS audit_id,
         CASE event_type WHEN 'view' THEN 'SELECT' WHEN 'click' THEN 'UPDATE' WHEN 'purchase' THEN 'EXPORT'
              WHEN 'signup' THEN 'LOGIN_FAILED' ELSE 'ERASURE' END AS event_type,
         CASE WHEN event_type <> 'signup' THEN {_pick(K.AUDIT_TABLES, 'user_id')} END AS table_name,
         user_id, {_pick(K.AUDIT_ROLES, 'user_id')} AS user_role, ts AS created_at
  FROM events),
access_events AS (
  SELECT CASE event_type WHEN 'signup' THEN 'LOGIN_FAILED' ELSE 'EXPORT' END AS event_type, user_id,
         '192.168.' || (user_id // 40 // 256) || '.' || (user_id // 40 % 256) AS ip_address,
         make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 200) AS created_at
  FROM events WHERE event_type IN ('signup', 'purchase')),
logs AS (
  SELECT event_id AS log_id, ts AS "timestamp", {_pick(K.LOG_SERVICES, 'user_id')} AS service,
         CASE WHEN event_type = 'signup' THEN 'audit' ELSE 'access' END AS type,
         CASE WHEN event_type = 'error' AND value >= 200 THEN 'critical' WHEN event_type = 'error' THEN 'error'
              WHEN value > 300 THEN 'warning' ELSE 'info' END AS severity,
         event_type || ' k=' || CAST(CAST(props->>'$.k' AS INTEGER) AS VARCHAR) AS message,
         CAST(CASE WHEN event_type = 'error' THEN 500 + event_id % 4 ELSE 200 END AS INTEGER) AS http_status,
         CAST(floor(value * 10) AS INTEGER) AS latency_ms
  FROM events),
session_events AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || strftime(date_trunc('week', ts), '%Y%m%d') AS session_id,
         user_id AS customer_id, {_pick(K.DEVICE_TYPES, 'user_id')} AS device_type, event_id,
         CASE WHEN event_type = 'view' THEN 'page_view' ELSE event_type END AS event,
         CASE WHEN event_type = 'view' THEN {_pick(K.FUNNEL_PAGES, "CAST(props->>'$.k' AS INTEGER)")} END AS page,
         CASE WHEN event_type = 'click' AND CAST(props->>'$.k' AS INTEGER) % 4 <> 0 THEN 'pay_button'
              WHEN event_type = 'click' THEN 'link' END AS element,
         event_type = 'purchase' AND CAST(props->>'$.k' AS INTEGER) % 5 = 0 AS completes,
         ts AS "timestamp"
  FROM events),
sessions AS (
  SELECT session_id, customer_id, device_type, min("timestamp") AS session_start, max("timestamp") AS session_end,
         count(*) AS event_count, count(*) FILTER (WHERE element = 'pay_button') AS pay_clicks,
         bool_or(completes) AS converted,
         (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) // 1000000 AS duration_seconds
  FROM session_events GROUP BY session_id, customer_id, device_type),
feedback AS (
  SELECT transaction_id AS feedback_id, customer_id, merchant_id, customer_country_code AS country_code,
         transaction_id, created_at + INTERVAL 2 DAY AS submitted_at,
         CASE WHEN transaction_id % 29 = 0 THEN 'renamed merchant'
              ELSE 'Supplier#' || lpad(CAST(merchant_id AS VARCHAR), 9, '0') END AS merchant_name,
         CAST((transaction_id // 7) % 5 + 1 AS INTEGER) AS overall, CAST((transaction_id // 7) % 11 AS INTEGER) AS nps_score,
         CASE (transaction_id // 7) % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['declined']
              WHEN 2 THEN ['declined', 'speed'] ELSE ['speed', 'support', 'checkout'] END AS tags
  FROM tx WHERE transaction_id % 7 = 2),
attempts AS (
  SELECT event_id AS transaction_id, user_id AS customer_id, user_id % 10 AS merchant_id,
         CAST(value AS DECIMAL(14,2)) AS amount, ts AS created_at
  FROM events),
"""

MARTS = f"""
dim_date AS (
  SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_sk, CAST(d AS DATE) AS full_date,
         CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month,
         strftime(d, '%B') AS month_name, CAST(weekofyear(d) AS INTEGER) AS week_of_year,
         CAST(day(d) AS INTEGER) AS day, CAST(isodow(d) AS INTEGER) AS day_of_week, strftime(d, '%A') AS day_name,
         isodow(d) >= 6 AS is_weekend, (month(d) = 1 AND day(d) = 1) OR (month(d) = 12 AND day(d) = 25) AS is_holiday,
         CAST(year(d) AS INTEGER) AS fiscal_year, CAST(quarter(d) AS INTEGER) AS fiscal_quarter
  FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d
        FROM (SELECT CAST(min(ts) AS DATE) - 31 AS lo, CAST(max(ts) AS DATE) + 31 AS hi
              FROM (SELECT created_at AS ts FROM tx UNION ALL SELECT created_at FROM audit_logs)))),
dim_geography AS (
  SELECT CAST(row_number() OVER (ORDER BY country_code) AS INTEGER) AS geography_sk, country_code,
         name AS country_name, region, data_region, gdpr_applies FROM countries),
dim_currency AS (SELECT CAST(pos AS INTEGER) AS currency_sk, currency_code, name, CAST(decimal_places AS INTEGER) AS decimal_places FROM currencies),
dim_payment_method AS (
  SELECT CAST(row_number() OVER (ORDER BY type, coalesce(brand, '')) AS INTEGER) AS payment_method_sk, type, brand,
         type = 'wallet' AS is_digital
  FROM (SELECT DISTINCT type, brand FROM payment_methods)),
dim_product AS (
  SELECT CAST(row_number() OVER (ORDER BY product_id) AS INTEGER) AS product_sk, product_id, merchant_id, name,
         billing_interval, unit_price, currency_code FROM products),
mh_flag AS (
  SELECT *, (lag(snapshot_date) OVER w IS NULL) OR (name IS DISTINCT FROM lag(name) OVER w)
            OR (category IS DISTINCT FROM lag(category) OVER w) OR (country_code IS DISTINCT FROM lag(country_code) OVER w)
            OR (status IS DISTINCT FROM lag(status) OVER w) AS is_new
  FROM merchant_history WINDOW w AS (PARTITION BY merchant_id ORDER BY snapshot_date)),
m_versions AS (
  SELECT merchant_id, name, category, mcc, country_code, status, snapshot_date AS scd_start,
         lead(snapshot_date) OVER (PARTITION BY merchant_id ORDER BY snapshot_date) AS scd_end
  FROM mh_flag WHERE is_new),
dim_merchant AS (
  SELECT CAST(row_number() OVER (ORDER BY v.merchant_id, v.scd_start) AS INTEGER) AS merchant_sk, v.merchant_id,
         v.name, v.category, v.mcc, v.country_code, c.region, v.status, v.scd_start, v.scd_end,
         v.scd_end IS NULL AS is_current
  FROM m_versions v LEFT JOIN countries c ON c.country_code = v.country_code),
dim_customer_base AS (
  SELECT CAST(row_number() OVER (ORDER BY cu.customer_id) AS INTEGER) AS customer_sk, cu.customer_id,
         sha256('{K.EMAIL_SALT}' || cu.email) AS email_hash, cu.country_code, co.region, co.data_region,
         CAST(date_trunc('month', cu.created_at) AS DATE) AS acquisition_month,
         CAST(cu.created_at AS DATE) AS scd_start, CAST(NULL AS DATE) AS scd_end, true AS is_current
  FROM customers cu LEFT JOIN countries co ON co.country_code = cu.country_code),
given_back AS (
  SELECT transaction_id, SUM(amount)::DECIMAL(16,2) AS back FROM refunds WHERE status = 'succeeded' GROUP BY transaction_id),
day_rates AS (SELECT currency_code, rate_date AS day, rate_to_usd AS rate FROM fx),
payment_values AS (
  SELECT transaction_id, ROUND(amount * rate, 2)::DECIMAL(16,2) AS amount_usd,
         (CASE status WHEN 'succeeded' THEN ROUND(amount * rate * 0.029 + 0.30, 2) ELSE 0 END)::DECIMAL(16,2) AS fee_usd,
         ifnull(ROUND(back * rate, 2)::DECIMAL(16,2), 0) AS refund_amount_usd, back IS NOT NULL AS is_refunded
  FROM (SELECT *, created_at::DATE AS day FROM tx) LEFT JOIN day_rates USING (currency_code, day)
       LEFT JOIN given_back USING (transaction_id)),
payment_risks AS (
  SELECT transaction_id, anomaly_score, risk_level, ifnull(risk_level IN ('high', 'critical'), false) AS is_fraud_flagged,
         transaction_id IN (SELECT transaction_id FROM disputes) AS is_disputed
  FROM (SELECT transaction_id FROM tx) LEFT JOIN fraud_indicators USING (transaction_id)),
instruments AS (
  SELECT payment_method_id, payment_method_sk FROM payment_methods, dim_payment_method
  WHERE dim_payment_method.type = payment_methods.type AND dim_payment_method.brand IS NOT DISTINCT FROM payment_methods.brand),
-- the version of a merchant or customer that was valid on the payment's day
seller_versions AS (
  SELECT transaction_id, merchant_sk FROM tx JOIN dim_merchant USING (merchant_id)
  WHERE scd_start <= created_at::DATE AND (scd_end IS NULL OR scd_end > created_at::DATE)),
buyer_versions AS (
  SELECT transaction_id, customer_sk FROM tx JOIN dim_customer_base USING (customer_id)
  WHERE scd_start <= tx.created_at::DATE AND (scd_end IS NULL OR scd_end > tx.created_at::DATE)),
fact_transactions AS (
  SELECT transaction_id, md5(transaction_id::VARCHAR) AS transaction_sk, strftime(tx.created_at, '%Y%m%d')::INTEGER AS date_sk,
         hour(tx.created_at)::SMALLINT AS hour_of_day, merchant_sk, customer_sk, geography_sk, payment_method_sk,
         product_sk, currency_sk, status, amount, amount_usd, fee_usd,
         (CASE status WHEN 'succeeded' THEN amount_usd - fee_usd - refund_amount_usd ELSE 0 END)::DECIMAL(16,2) AS net_amount_usd,
         refund_amount_usd, is_refunded, is_disputed, is_fraud_flagged, subscription_id IS NOT NULL AS is_subscription,
         anomaly_score, risk_level, device_type, tx.created_at, tx.created_at + INTERVAL 2 MINUTE AS loaded_at
  FROM tx JOIN payment_values USING (transaction_id) JOIN payment_risks USING (transaction_id)
       JOIN seller_versions USING (transaction_id) JOIN buyer_versions USING (transaction_id)
       JOIN instruments USING (payment_method_id) JOIN dim_currency USING (currency_code)
       JOIN dim_geography ON dim_geography.country_code = tx.geo_country_code
       LEFT JOIN (SELECT product_id, product_sk FROM dim_product) USING (product_id)),
spend AS (
  SELECT customer_sk, SUM(amount_usd) AS spend FROM fact_transactions WHERE status = 'succeeded' GROUP BY customer_sk),
customer_segments AS (
  SELECT customer_sk, spend, dec AS decile,
         CASE WHEN dec >= 9 THEN 'high_value' WHEN dec >= 5 THEN 'mid_value' ELSE 'low_value' END AS segment
  FROM (SELECT *, CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, (10 * (rn - 1) + (n - 1) - 1) // (n - 1)) END AS INTEGER) AS dec
        FROM (SELECT *, row_number() OVER (ORDER BY spend, customer_sk) AS rn, count(*) OVER () AS n FROM spend))),
dim_customer AS (
  SELECT b.customer_sk, b.customer_id, b.email_hash, b.country_code, b.region, b.data_region,
         COALESCE(s.segment, 'low_value') AS segment, b.acquisition_month, b.scd_start, b.scd_end, b.is_current
  FROM dim_customer_base b LEFT JOIN customer_segments s ON s.customer_sk = b.customer_sk),
fact_audit_events AS (
  SELECT audit_id AS audit_sk, audit_id, CAST(strftime(created_at, '%Y%m%d') AS INTEGER) AS date_sk, event_type,
         table_name, user_role, substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS user_id_hash,
         COALESCE(table_name IN ('payment_methods', 'customers'), false) OR event_type IN ('EXPORT', 'ERASURE')
           AS is_sensitive
  FROM audit_logs),
agg_daily_revenue AS (
  SELECT f.date_sk, f.merchant_sk, cur.currency_code,
         CAST(count(*) AS INTEGER) AS transaction_count,
         CAST(count(*) FILTER (WHERE f.status = 'succeeded') AS INTEGER) AS succeeded_count,
         CAST(count(*) FILTER (WHERE f.status = 'failed') AS INTEGER) AS failed_count,
         CAST(SUM(CASE WHEN f.status = 'succeeded' THEN f.amount ELSE 0 END) AS DECIMAL(16,2)) AS total_amount,
         CAST(SUM(CASE WHEN f.status = 'succeeded' THEN f.amount_usd ELSE 0 END) AS DECIMAL(16,2)) AS total_amount_usd,
         CAST(SUM(f.net_amount_usd) AS DECIMAL(16,2)) AS net_amount_usd,
         CAST(count(*) FILTER (WHERE f.is_refunded) AS INTEGER) AS refund_count,
         CAST(count(*) FILTER (WHERE f.is_disputed) AS INTEGER) AS dispute_count,
         CAST(count(*) FILTER (WHERE f.is_fraud_flagged) AS INTEGER) AS fraud_count
  FROM fact_transactions f JOIN dim_currency cur ON cur.currency_sk = f.currency_sk
  GROUP BY f.date_sk, f.merchant_sk, cur.currency_code),
agg_monthly_fraud AS (
  SELECT year_month, geography_sk, CAST(count(*) AS INTEGER) AS total_transactions,
         CAST(count(*) FILTER (WHERE is_fraud_flagged) AS INTEGER) AS total_flagged,
         CAST(count(*) FILTER (WHERE risk_level = 'critical') AS INTEGER) AS total_critical,
         CAST(count(*) FILTER (WHERE is_disputed) AS INTEGER) AS total_disputed,
         CAST({_avg4('anomaly_score')} AS DECIMAL(5,4)) AS avg_anomaly_score,
         CAST(ROUND(CAST(count(*) FILTER (WHERE is_fraud_flagged) AS DECIMAL(18,3)) * 100 / count(*), 3) AS DECIMAL(6,3))
           AS fraud_rate_pct
  FROM (SELECT *, substr(CAST(date_sk AS VARCHAR), 1, 4) || '-' || substr(CAST(date_sk AS VARCHAR), 5, 2) AS year_month
        FROM fact_transactions)
  GROUP BY year_month, geography_sk),
mv_monthly_revenue_by_country AS (
  SELECT d.year, d.month, g.country_code, g.region, count(*) AS transaction_count,
         CAST(SUM(CASE WHEN f.status = 'succeeded' THEN f.amount_usd ELSE 0 END) AS DECIMAL(18,2)) AS revenue_usd,
         CAST(SUM(f.net_amount_usd) AS DECIMAL(18,2)) AS net_revenue_usd,
         count(*) FILTER (WHERE f.is_fraud_flagged) AS fraud_count
  FROM fact_transactions f JOIN dim_date d ON d.date_sk = f.date_sk JOIN dim_geography g ON g.geography_sk = f.geography_sk
  GROUP BY d.year, d.month, g.country_code, g.region),
"""

FEATURES = f"""
cur_stats AS (
  SELECT currency_code, avg(CAST(amount AS DOUBLE)) AS mu, stddev_samp(CAST(amount AS DOUBLE)) AS sd
  FROM tx GROUP BY currency_code),
shared_fp AS (
  SELECT fingerprint FROM payment_methods WHERE fingerprint IS NOT NULL GROUP BY fingerprint
  HAVING count(DISTINCT customer_id) >= 2),
fw AS (
  SELECT t.*,
         count(*) OVER (PARTITION BY customer_id ORDER BY created_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)
           - count(*) OVER (PARTITION BY customer_id, created_at)
           + row_number() OVER (PARTITION BY customer_id, created_at ORDER BY transaction_id) - 1 AS n1h,
         count(*) OVER (PARTITION BY customer_id ORDER BY created_at RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)
           - count(*) OVER (PARTITION BY customer_id, created_at)
           + row_number() OVER (PARTITION BY customer_id, created_at ORDER BY transaction_id) - 1 AS n24h,
         sum(CAST(amount * 100 AS BIGINT)) OVER (PARTITION BY customer_id ORDER BY created_at
                                                 RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS cents30,
         count(*) OVER (PARTITION BY customer_id ORDER BY created_at
                        RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS n30,
         count(DISTINCT geo_country_code) OVER (PARTITION BY customer_id ORDER BY created_at
                                                RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS cty30,
         row_number() OVER (PARTITION BY customer_id, device_type ORDER BY created_at, transaction_id) > 1 AS device_seen_before
  FROM tx t),
fraud_features AS (
  SELECT w.transaction_id, w.customer_id, w.merchant_id, w.created_at, w.status,
         ROUND((CAST(w.amount AS DOUBLE) - s.mu) / s.sd, 3) AS amount_zscore,
         CAST(w.n1h AS INTEGER) AS transactions_last_1h, CAST(w.n24h AS INTEGER) AS transactions_last_24h,
         CAST((2 * w.cents30 + w.n30) // (2 * w.n30) AS DOUBLE) / 100 AS avg_amount_30d, CAST(w.cty30 AS INTEGER) AS distinct_countries_30d,
         w.geo_country_code <> w.customer_country_code AS geo_mismatch, hour(w.created_at) < 6 AS night_transaction,
         ROUND(least(1.0, w.n1h / 5.0), 3) AS velocity_score, w.device_seen_before,
         COALESCE(pm.fingerprint IN (SELECT fingerprint FROM shared_fp), false) AS shared_card_fingerprint,
         CAST((w.transaction_id * 13) % 100 AS DOUBLE) / 100 AS ip_reputation_score
  FROM fw w JOIN cur_stats s ON s.currency_code = w.currency_code
  LEFT JOIN payment_methods pm ON pm.payment_method_id = w.payment_method_id),
labels AS (
  SELECT t.transaction_id,
         CASE WHEN d.status = 'lost' THEN true WHEN d.status = 'won' THEN false WHEN a.is_fraud IS NOT NULL THEN a.is_fraud
              WHEN t.created_at <= (SELECT max(created_at) FROM tx) - INTERVAL 121 DAY AND t.status = 'succeeded' THEN false
         END AS is_fraud,
         CASE WHEN d.status = 'lost' THEN 'chargeback' WHEN d.status = 'won' THEN 'dispute_won'
              WHEN a.is_fraud IS NOT NULL THEN 'analyst_review'
              WHEN t.created_at <= (SELECT max(created_at) FROM tx) - INTERVAL 121 DAY AND t.status = 'succeeded'
                THEN 'matured_no_dispute' END AS source
  FROM tx t LEFT JOIN disputes d ON d.transaction_id = t.transaction_id
  LEFT JOIN analyst_reviews a ON a.transaction_id = t.transaction_id),
ml_flat AS (
  SELECT f.*, l.is_fraud AS label_is_fraud, l.source AS label_source, p AS fraud_probability, {_risk('p')} AS risk_level,
         {_action('p')} AS action_taken, '{K.MODEL_VERSION}' AS model_version,
         array_to_string(list_transform(list_slice(list_sort([
             {{'neg': -CAST(CASE WHEN geo_mismatch THEN 0.31 ELSE 0.02 END AS DOUBLE), 'idx': 0, 'feature': 'geo_mismatch'}},
             {{'neg': -ROUND(ip_reputation_score * 0.4, 3), 'idx': 1, 'feature': 'ip_reputation_score'}},
             {{'neg': -ROUND(velocity_score * 0.3, 3), 'idx': 2, 'feature': 'velocity_score'}},
             {{'neg': -ROUND(greatest(0.0, amount_zscore) * 0.08, 3), 'idx': 3, 'feature': 'amount_zscore'}},
             {{'neg': -CAST(CASE WHEN shared_card_fingerprint THEN 0.25 ELSE 0.01 END AS DOUBLE), 'idx': 4, 'feature': 'shared_card_fingerprint'}},
             {{'neg': -CAST(CASE WHEN night_transaction THEN 0.09 ELSE 0.01 END AS DOUBLE), 'idx': 5, 'feature': 'night_transaction'}}
           ]), 1, 3), lambda x: x.feature), ',') AS top_factors
  FROM (SELECT *, CAST({_score('transaction_id')} AS DOUBLE) AS p FROM fraud_features) f
  LEFT JOIN labels l ON l.transaction_id = f.transaction_id),
"""

ALL_CTES = (VIEWS + MARTS + FEATURES).rstrip().rstrip(",")


def wrap(body: str, recursive: bool = False) -> str:
    """Prefix a query (which may start with its own ``name AS (...)`` CTEs) with the shared views."""
    body = body.strip()
    head = "WITH RECURSIVE" if recursive else "WITH"
    if body.upper().startswith("SELECT"):
        return f"{head} {ALL_CTES}\n{body}"
    return f"{head} {ALL_CTES},\n{body}"
