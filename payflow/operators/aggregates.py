"""Aggregate helpers: exact percentiles from value histograms, modes, safe ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram_percentile(df: DataFrame, keys: list[str], value: str, p: float, method: str = "disc",
                         name: str | None = None) -> DataFrame:
    """Exact percentile per group from a (group, value) -> count histogram.

    ``disc``: smallest value whose cumulative share >= p (SQL ``percentile_disc``).
    ``floor``: element at 0-based position floor(p * n) of the sorted list.

    The histogram is a partial aggregate; the running count is a window over the
    *distinct values* of one group, so a hot group with a bounded value domain
    (latencies in ms) stays small.
    """
    name = name or f"p{int(round(p * 100))}_{value}"
    h = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_cum", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    if method == "disc":
        target = F.ceil(F.lit(p) * F.col("_n"))
        target = F.greatest(target, F.lit(1))
    elif method == "floor":
        target = F.least(F.floor(F.lit(p) * F.col("_n")) + 1, F.col("_n"))
    else:
        raise ValueError(method)
    return (h.filter(F.col("_cum") >= target).groupBy(*keys).agg(F.min(value).alias(name)))


def mode_of(col: str) -> Column:
    """Most frequent non-null value; ties -> smallest value."""
    return F.mode(col, True)
