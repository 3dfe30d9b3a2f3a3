"""Slowly changing dimensions (type 2): build, apply a snapshot, and point-in-time joins.

Versions use half-open validity ``[scd_start, scd_end)``; the open end is NULL and
``is_current`` marks it. A key's history is short, so per-key windows here are
bounded by the number of versions of one entity, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def versions_from_snapshots(snaps: DataFrame, key: str, check_cols: list[str], snapshot_col: str) -> DataFrame:
    """Collapse dated snapshots into SCD2 versions (strategy *check* on ``check_cols``).

    A new version starts at a snapshot whose checked columns differ (null-safe) from the
    previous snapshot of the same key.
    """
    w = Window.partitionBy(key).orderBy(snapshot_col)
    changed = F.lit(False)
    for c in check_cols:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.lag(snapshot_col).over(w).isNull()
    starts = snaps.withColumn("_new", first | changed).filter("_new").drop("_new")
    return (starts.withColumnRenamed(snapshot_col, "scd_start")
            .withColumn("scd_end", F.lead("scd_start").over(Window.partitionBy(key).orderBy("scd_start")))
            .withColumn("is_current", F.col("scd_end").isNull()))


def scd2_apply(dim: DataFrame, snapshot: DataFrame, key: str, check_cols: list[str], as_of: str) -> DataFrame:
    """Apply one snapshot (``as_of`` date) to an SCD2 dimension without surrogate keys.

    * history rows (not current) pass through;
    * current rows whose checked columns changed are closed at ``as_of`` and a new
      version opens at ``as_of``;
    * new keys open a version at ``as_of``; keys absent from the snapshot stay open.
    Idempotent: applying the same snapshot twice gives the same table.
    """
    d = F.to_date(F.lit(as_of))
    hist = dim.filter(~F.col("is_current"))
    cur = dim.filter(F.col("is_current"))
    payload = [c for c in snapshot.columns if c != key]
    j = cur.alias("c").join(snapshot.withColumn("_snap_present", F.lit(True)).alias("s"), key, "full_outer")
    diff = F.lit(False)
    for c in check_cols:
        diff = diff | ~F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}"))
    in_cur = F.col("c.scd_start").isNotNull()
    in_snap = F.col("_snap_present").isNotNull()
    changed = in_cur & in_snap & diff
    keep_cur = j.filter(in_cur & ~(in_snap & diff)).select(key, *[F.col(f"c.{c}").alias(c) for c in payload],
                                                             "c.scd_start", "c.scd_end", "c.is_current")
    closed = j.filter(changed).select(key, *[F.col(f"c.{c}").alias(c) for c in payload],
                                      "c.scd_start", d.alias("scd_end"), F.lit(False).alias("is_current"))
    opened = j.filter(in_snap & (~in_cur | diff)).select(
        key, *[F.col(f"s.{c}").alias(c) for c in payload], d.alias("scd_start"),
        F.lit(None).cast("date").alias("scd_end"), F.lit(True).alias("is_current"))
    cols = [key, *payload, "scd_start", "scd_end", "is_current"]
    return (hist.select(cols).unionByName(keep_cur.select(cols)).unionByName(closed.select(cols))
            .unionByName(opened.select(cols)))


def scd2_as_of(fact: DataFrame, dim: DataFrame, key: str, at: Column, select: list[str],
               on_miss: str = "drop", start: str = "scd_start", end: str = "scd_end") -> DataFrame:
    """Point-in-time join: the dimension version valid on date ``at``.

    Condition: ``dim.key = fact.key AND start <= at < coalesce(end, 9999-12-31)``: an
    equi-join on the key with a range residual (sort-merge or broadcast hash join on
    the key; the residual only scans one entity's few versions).

    ``on_miss``: "drop" (inner join) or "latest" (fall back to the current version).
    For "latest" the dimension side is completed first (``_uncovered_spans``): every date
    range of a key that no version covers becomes a row carrying the current version's
    columns, so the fact passes through one left join and nothing is re-joined.
    """
    d = dim.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"),
                   F.col("is_current").alias("_cur"), *select)
    cond = (F.col(key) == F.col("_k")) & (at >= F.col("_s")) & (at < F.coalesce(F.col("_e"), F.to_date(F.lit(OPEN_END))))
    if on_miss == "drop":
        return fact.join(d, cond, "inner").drop("_k", "_s", "_e", "_cur")
    if on_miss != "latest":
        raise ValueError(on_miss)
    cur = d.filter("_cur").select("_k", *select)
    filler = _uncovered_spans(d).join(cur, "_k", "left")
    full = d.select("_k", "_s", "_e", *select).unionByName(filler.select("_k", "_s", "_e", *select))
    return fact.join(full, cond, "left").drop("_k", "_s", "_e")


def _uncovered_spans(d: DataFrame) -> DataFrame:
    """(_k, _s, _e) ranges of each key that no version covers: before the first version,
    between non-adjacent versions, and after a closed last version (``_e`` NULL = open).
    A per-key window over the versions of one entity (short)."""
    w = Window.partitionBy("_k").orderBy("_s")
    v = d.select("_k", "_s", "_e", F.lead("_s").over(w).alias("_next"), F.row_number().over(w).alias("_i"))
    lo = F.to_date(F.lit("0001-01-01"))
    before = v.filter(F.col("_i") == 1).select("_k", lo.alias("_s"), F.col("_s").alias("_e"))
    gaps = v.filter(F.col("_e").isNotNull() & (F.col("_next").isNull() | (F.col("_next") > F.col("_e")))) \
        .select("_k", F.col("_e").alias("_s"), F.col("_next").alias("_e"))
    return before.unionByName(gaps)
