"""Top-k operators that never gather a whole group in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """``ORDER BY ... LIMIT k`` (TakeOrderedAndProject: per-partition top-k, then merge)."""
    return df.orderBy(*order).limit(k)


def first_k_by(df: DataFrame, keys: list[str], order: list[str], value: str, k: int,
               name: str | None = None) -> DataFrame:
    """Per group of ``keys``, the first ``k`` values of ``value`` in ``order`` (ascending), as an array.

    A row number kept up to ``k``: Spark limits every group to k rows in each map task before
    the shuffle (window group limit), so a hot group moves tasks x k rows, and the array that
    is gathered has k entries. ``order`` must make rows unique.
    """
    name = name or value
    w = Window.partitionBy(*keys).orderBy(*order)
    top = df.select(*keys, *[c for c in dict.fromkeys([*order, value]) if c not in keys]) \
        .withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k)
    got = F.array_sort(F.collect_list(F.struct("_k", F.col(value).alias("_v"))))
    return top.groupBy(*keys).agg(F.filter(F.transform(got, lambda x: x["_v"]), lambda x: x.isNotNull()).alias(name))


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY order) <= n``; for groups whose size
    is bounded (e.g. segments of one merchant)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
