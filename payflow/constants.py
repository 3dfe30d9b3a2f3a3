"""Fixed values that results depend on.

These are the lookup values of the payment model (currencies with their base rate to
USD and decimals, merchant categories with their MCC, enumerations, thresholds, model
weights). They are stated here once, plainly, in their natural order.
"""

# --- fixed values: currencies (code, name, decimal places, base rate to USD) ---
CURRENCIES = [
    ("USD", "US Dollar", 2, "1.00"),
    ("EUR", "Euro", 2, "1.08"),
    ("GBP", "British Pound", 2, "1.27"),
    ("CAD", "Canadian Dollar", 2, "0.74"),
    ("BRL", "Brazilian Real", 2, "0.18"),
    ("SGD", "Singapore Dollar", 2, "0.75"),
    ("JPY", "Japanese Yen", 0, "0.0067"),
    ("AUD", "Australian Dollar", 2, "0.66"),
    ("NGN", "Nigerian Naira", 2, "0.00065"),
]

# --- fixed values: merchant categories and their MCC ---
MERCHANT_CATEGORIES = [
    ("e-commerce", "5399"),
    ("saas", "5734"),
    ("marketplace", "5999"),
    ("food_delivery", "5812"),
    ("travel", "4722"),
    ("gaming", "7994"),
    ("healthcare", "8099"),
    ("education", "8299"),
    ("retail", "5311"),
]

# --- fixed values: enumerations ---
PAYMENT_TYPES = ["card", "bank_transfer", "wallet"]
CARD_BRANDS = ["visa", "mastercard", "amex", "discover"]
WALLET_BRANDS = ["apple_pay", "google_pay", "paypal"]
DEVICE_TYPES = ["mobile", "desktop", "tablet"]
FAILURE_REASONS = ["insufficient_funds", "card_declined", "expired_card", "processing_error",
                   "authentication_required"]
LOG_SERVICES = ["payment-api", "fraud-service", "auth-service", "webhook-service", "checkout-web"]
FUNNEL_PAGES = ["/", "/products", "/product/42", "/cart", "/checkout", "/confirmation"]
AUDIT_TABLES = ["transactions", "customers", "payment_methods", "merchants", "refunds"]
AUDIT_ROLES = ["analyst", "support", "admin", "service"]
SUBSCRIPTION_STATUSES = ["active", "past_due", "canceled"]
DISPUTE_STATUSES = ["needs_response", "under_review", "won", "lost"]
SEGMENTS = ["high_value", "mid_value", "low_value"]
FEEDBACK_TAGS = ["declined", "speed", "support", "checkout"]
MODEL_VERSION = "fraud-xgb-v2.4.1"
SENSITIVE_TABLES = ["payment_methods", "customers"]
SENSITIVE_EVENTS = ["EXPORT", "ERASURE"]

# --- fixed values: fees, salts, thresholds ---
FEE_PCT = "0.029"
FEE_FIXED_USD = "0.30"
EMAIL_SALT = "demo-salt-rotate-in-prod"
# risk level thresholds on the fraud probability: < .30 low, < .60 medium, < .85 high, else critical
RISK_THRESHOLDS = [(0.30, "low", "allow"), (0.60, "medium", "challenge_3ds"), (0.85, "high", "review")]
RISK_TOP = ("critical", "block")
FRAUD_RATE_BOUNDS = (0.005, 0.20)

# --- fixed values: reference weighted logit of the fraud signals (no noise term) ---
LOGIT_INTERCEPT = -4.2
LOGIT_WEIGHTS = {
    "geo_mismatch": 2.4,
    "night_transaction": 0.9,
    "amount_zscore_excess": 0.7,   # applied to max(0, z - 1.5)
    "velocity_ge_3": 1.6,
    "new_device": 0.8,
    "ip_reputation_score": 3.0,
    "shared_card_fingerprint": 1.8,
}

# --- fixed values: per-feature explanation weights (top factors) ---
FACTOR_RULES = [
    ("geo_mismatch", "flag", 0.31, 0.02),
    ("ip_reputation_score", "scale", 0.4, None),
    ("velocity_score", "scale", 0.3, None),
    ("amount_zscore", "scale_pos", 0.08, None),
    ("shared_card_fingerprint", "flag", 0.25, 0.01),
    ("night_transaction", "flag", 0.09, 0.01),
]
