"""Reusable data checks: parents exist, history unchanged, document rules, failing rows kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_parent(child: DataFrame, parent: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Split child rows into (with parent, orphans) with a semi and an anti join."""
    p = parent.select(key).distinct()
    return child.join(p, key, "left_semi"), child.join(p, key, "left_anti")


def row_hash(df: DataFrame, cols: list[str] | None = None) -> Column:
    cols = cols or df.columns
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in cols])), 256)


def check_append_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the old version that were changed or removed in the new one (must be
    empty for an append-only log). One anti join on (key, row hash)."""
    o = old.select(key, row_hash(old).alias("_h"))
    n = new.select(key, row_hash(new.select(*old.columns)).alias("_h"))
    gone = o.join(n, [key, "_h"], "left_anti")
    changed_keys = gone.join(n.select(key), key, "left_semi").select(key).withColumn("problem", F.lit("modified"))
    removed = gone.join(n.select(key), key, "left_anti").select(key).withColumn("problem", F.lit("deleted"))
    return changed_keys.unionByName(removed)


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Count of rows failing each rule (rule column is the *valid* condition;
    null counts as a failure). One aggregate pass, one output row per rule."""
    names = list(rules)
    agg = df.agg(*[F.count_if(~F.coalesce(rules[n], F.lit(False))).alias(f"_r{i}") for i, n in enumerate(names)])
    arr = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_r{i}").alias("violations"))
                    for i, n in enumerate(names)])
    return agg.select(F.inline(arr))


def store_failures(df: DataFrame, rules: dict[str, Column], path: str) -> None:
    """Keep the failing rows of every rule (``--store-failures``), one folder per rule."""
    tagged = df.withColumn("_failed", F.array_compact(F.array(
        *[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))
    (tagged.filter(F.size("_failed") > 0).withColumn("rule", F.explode("_failed")).drop("_failed")
     .write.mode("overwrite").partitionBy("rule").parquet(path))
