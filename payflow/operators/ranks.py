"""Global ranks without a single-partition window.

``row_number() OVER (ORDER BY x)`` with no PARTITION BY moves every row into one
task. Here the rows are range-partitioned on the order key, sorted inside each
partition, numbered locally, and shifted by the running count of the earlier
partitions. The offsets table has one row per partition (a proven small bound),
so it is broadcast. Ties must be broken by a unique column for a stable result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payflow.session import ensure_checkpoint_dir


def _default_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_row_number(df: DataFrame, order: list[Column | str], name: str = "rn",
                      num_partitions: int | None = None, with_total: str | None = None) -> DataFrame:
    """Add a 1-based ``name`` = row number in ``order`` (ascending/descending Columns allowed).

    ``with_total`` optionally adds the total row count as a column of that name.
    """
    n = num_partitions or _default_parts(df)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    local = (ranged.withColumn("_pid", F.spark_partition_id())
             .withColumn("_mid", F.monotonically_increasing_id()))
    # _mid = (partition id << 33) + position inside the partition
    local = local.withColumn("_lrn", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33) + 1)
    # Counts and numbering must see the same partitioning. Two range exchanges of the
    # same data may sample different boundaries, so the numbered rows are written once
    # (reliable checkpoint in the shared checkpoint folder) and both branches read them.
    ensure_checkpoint_dir(df.sparkSession)
    local = local.checkpoint(eager=True)
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(Window.partitionBy()).alias("_tot"))
    out = local.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_lrn"))
    if with_total:
        out = out.withColumn(with_total, F.col("_tot"))
    return out.drop("_pid", "_mid", "_lrn", "_off", "_tot")


def ntile_expr(rn: Column, total: Column, buckets: int) -> Column:
    """SQL ``NTILE(buckets)`` from a 1-based row number and the row count."""
    q = (total / buckets).cast("long")
    r = total % buckets
    big = r * (q + 1)
    return F.when(rn <= big, ((rn - 1) / (q + 1)).cast("long") + 1) \
        .otherwise(r + ((rn - big - 1) / F.greatest(q, F.lit(1))).cast("long") + 1).cast("int")


def ntile(df: DataFrame, order: list[Column | str], buckets: int = 10, name: str = "ntile") -> DataFrame:
    """``NTILE(buckets) OVER (ORDER BY order)`` computed at scale."""
    out = global_row_number(df, order, "_rn", with_total="_n")
    return out.withColumn(name, ntile_expr(F.col("_rn"), F.col("_n"), buckets)).drop("_rn", "_n")


def rank_deciles_expr(rn: Column, total: Column, buckets: int = 10) -> Column:
    """Quantile cut of ``rank(method='first')`` into equal-width rank bins (pandas ``qcut``).

    bin = max(1, ceil(buckets * (rn - 1) / (n - 1))); one row -> bin 1.
    """
    num = (rn - 1) * buckets
    den = total - 1
    return F.when(total <= 1, F.lit(1)).otherwise(
        F.greatest(F.lit(1), ((num + den - 1) / den).cast("long"))).cast("int")


def rank_deciles(df: DataFrame, order: list[Column | str], buckets: int = 10, name: str = "decile") -> DataFrame:
    out = global_row_number(df, order, "_rn", with_total="_n")
    return out.withColumn(name, rank_deciles_expr(F.col("_rn"), F.col("_n"), buckets)).drop("_rn", "_n")


def dense_key(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Dense surrogate numbering 1..n in ``order`` (unique order assumed)."""
    return global_row_number(df, order, name).withColumn(name, F.col(name).cast("long"))


def group_row_number(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rn",
                     num_partitions: int | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY order)`` that splits a hot group.

    Rows are range-partitioned on (keys, order), so one large group spans several
    partitions; each partition numbers its rows locally, and the offset of a group in a
    partition is the count of that group's rows in earlier partitions (a window over at
    most ``num_partitions`` rows per group). ``order`` must make rows unique in a group.
    """
    n = num_partitions or _default_parts(df)
    cols = [F.col(c) for c in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    local = (ranged.withColumn("_pid", F.spark_partition_id())
             .withColumn("_mid", F.monotonically_increasing_id()))
    ensure_checkpoint_dir(df.sparkSession)
    local = local.checkpoint(eager=True)          # one partitioning for both branches (see above)
    firsts = local.groupBy(*keys, "_pid").agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = firsts.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    out = local.join(offs, [*keys, "_pid"]).withColumn(name, F.col("_off") + F.col("_mid") - F.col("_m0") + 1)
    return out.drop("_pid", "_mid", "_m0", "_off")


def group_running_sum(df: DataFrame, keys: list[str], order: list[Column | str], value: str, name: str,
                      number: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """``SUM(value) OVER (PARTITION BY keys ORDER BY order)`` (and the row number, if ``number`` is given) that
    splits a hot group as ``group_row_number`` does: local sums inside range partitions, plus the
    totals of the group's earlier partitions. ``order`` must make rows unique in a group."""
    n = num_partitions or _default_parts(df)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ensure_checkpoint_dir(df.sparkSession)
    local = df.repartitionByRange(n, *[F.col(c) for c in keys], *order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    own = Window.partitionBy(*keys, "_pid").orderBy(*order)
    local = local.withColumns({name: F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)), "_i": F.row_number().over(own)})
    totals = local.groupBy(*keys, "_pid").agg(F.sum(value).alias("_t"), F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_pid", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"),
                            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_oc"))
    out = local.join(offsets, [*keys, "_pid"]).withColumn(name, F.col(name) + F.col("_o"))
    if number:
        out = out.withColumn(number, F.col("_i") + F.col("_oc"))
    return out.drop("_pid", "_i", "_o", "_oc")


def global_running_sums(df: DataFrame, order: list[Column | str], sums: dict[str, tuple[str, str]],
                        num_partitions: int | None = None) -> DataFrame:
    """``SUM(x) OVER (ORDER BY order)`` and the grand total of several columns without a one-task
    window: ``sums`` maps a column to the names of its running sum and its total. Range
    partitions keep local running sums; one row per partition carries the earlier ones' totals."""
    n = num_partitions or _default_parts(df)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ensure_checkpoint_dir(df.sparkSession)
    local = df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    totals = local.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
                            *[F.sum(f"_t_{c}").over(Window.partitionBy()).alias(t) for c, (_, t) in sums.items()])
    own = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = local.withColumns({run: F.sum(c).over(own) for c, (run, _) in sums.items()}).join(F.broadcast(offsets), "_pid")
    return out.withColumns({run: F.col(run) + F.col(f"_o_{c}") for c, (run, _) in sums.items()}).drop(
        "_pid", *[f"_o_{c}" for c in sums])
