"""Scalar Column expressions shared by the jobs (money, calendar, hashing, risk)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from payflow import constants as K

__all__ = [
    "pick", "money", "round_money", "round_for_currency", "safe_ratio", "pct",
    "date_sk", "hour_of_day", "year_month_of_sk", "month_index", "months_between_ym",
    "salted_sha256", "short_sha256", "ip_to_24", "looks_like_email", "surrogate_md5",
    "risk_level", "risk_action", "sigmoid", "add_seconds", "as_double_money",
]


def pick(values: list, idx: Column) -> Column:
    """``values[idx]`` for a 0-based integer index column (array literal, no join)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values)).cast("int") + 1)


def money(c: Column | str, precision: int = 14) -> Column:
    """Money enters as double in some sources: cast to DECIMAL(p,2) before any sum."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(f"decimal({precision},2)")


def round_money(c: Column, scale: int = 2) -> Column:
    """SQL rounding (half away from zero) on a decimal."""
    return F.round(c, scale)


def round_for_currency(amount: Column, decimals: Column) -> Column:
    """Currency-aware rounding: zero-decimal currencies (JPY) get whole units."""
    return F.when(decimals == 0, F.round(amount, 0).cast("decimal(14,2)")).otherwise(amount)


def as_double_money(c: Column, scale: int = 2) -> Column:
    """Round a decimal and hand it out as a double (portable result type)."""
    return F.round(c, scale).cast("double")


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / NULLIF(den, 0)`` as double."""
    return num.cast("double") / F.when(den != 0, den.cast("double"))


def pct(num: Column, den: Column, scale: int = 2) -> Column:
    """Percentage ``round(num * 100 / nullif(den, 0), scale)`` computed in double."""
    return F.round(num.cast("double") * 100.0 / F.when(den != 0, den.cast("double")), scale)


def date_sk(ts: Column) -> Column:
    """``to_char(ts, 'YYYYMMDD')::int``."""
    return F.date_format(ts, "yyyyMMdd").cast("int")


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def year_month_of_sk(sk: Column) -> Column:
    """'YYYY-MM' text from an integer YYYYMMDD key."""
    s = sk.cast("string")
    return F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2))


def month_index(year: Column, month: Column) -> Column:
    """``year * 100 + month``."""
    return year * 100 + month


def months_between_ym(ym_to: Column, ym_from: Column) -> Column:
    """Month distance of two YYYYMM integers with integer division: (y2-y1)*12 + (m2-m1)."""
    y2, y1 = ym_to.cast("int"), ym_from.cast("int")
    return (F.floor(y2 / 100) - F.floor(y1 / 100)).cast("int") * 12 + (y2 % 100 - y1 % 100)


def salted_sha256(c: Column, salt: str = K.EMAIL_SALT) -> Column:
    return F.sha2(F.concat(F.lit(salt), c), 256)


def short_sha256(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(c.cast("string"), 256), 1, n)


def ip_to_24(ip: Column) -> Column:
    """Pseudonymize an IPv4 address to its /24 network (last octet set to 0)."""
    return F.regexp_replace(ip, r"\.[0-9]+$", ".0")


def looks_like_email(c: Column) -> Column:
    return c.like("%@%")


def surrogate_md5(*cols: Column) -> Column:
    """Surrogate key as md5 of the '-'-joined text of the keys."""
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit("_null_")) for c in cols]))


def risk_level(prob: Column) -> Column:
    expr = F.lit(K.RISK_TOP[0])
    for bound, level, _ in reversed(K.RISK_THRESHOLDS):
        expr = F.when(prob < bound, F.lit(level)).otherwise(expr)
    return expr


def risk_action(prob: Column) -> Column:
    expr = F.lit(K.RISK_TOP[1])
    for bound, _, action in reversed(K.RISK_THRESHOLDS):
        expr = F.when(prob < bound, F.lit(action)).otherwise(expr)
    return expr


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def add_seconds(ts: Column, secs: Column) -> Column:
    return F.timestamp_add("SECOND", secs, ts)
