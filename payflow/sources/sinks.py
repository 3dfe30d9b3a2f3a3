"""Sinks: mart writes, month-partitioned transactions, archive, change-log state, compaction.

Keyed state is a change log in levels: a batch adds its own rows as a run of level 0, in key
buckets, and when a level holds ``RUNS_PER_LEVEL`` runs they are merged into one of the next
level, so readers take the latest row per key over about log(batches) runs. Deletes stay in the
log as tombstones and are hidden on read, so a late older change never revives a key, and there is
no pointer that could be lost: every state of the folder between two writes reads as a valid table.
Partition-scoped merges use dynamic partition overwrite, so only touched months are
rewritten.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payflow.operators.windows import latest_per_key
from payflow.session import ensure_checkpoint_dir


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_mart(df: DataFrame, path: str, mode: str = "overwrite", sort_by: list[str] | None = None) -> None:
    """A10: write one mart as Parquet (rows sorted inside files for zone maps)."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    out.write.mode(mode).parquet(path)


def with_year_month(df: DataFrame, ts: str = "created_at") -> DataFrame:
    return df.withColumn("year_month", F.date_format(ts, "yyyy-MM"))


def write_transactions(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """Month partitions (``year_month=YYYY-MM``); rows without a time land in the
    default partition (``__HIVE_DEFAULT_PARTITION__``). Touched months are replaced. Rows are
    range-partitioned on (month, time), so a large month is written by several tasks."""
    (with_year_month(df, ts).repartitionByRange("year_month", ts).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("year_month").parquet(path))


def archive_months(spark: SparkSession, path: str, archive_path: str, cutoff_month: str) -> list[str]:
    """Copy month partitions older than ``cutoff_month`` to the archive, then drop them
    from the hot table. Returns the archived months (partition names only)."""
    hot = spark.read.parquet(path)
    old = hot.filter(F.col("year_month") < cutoff_month)
    months = [r[0] for r in old.select("year_month").distinct().collect()]   # month names: bounded
    if not months:
        return []
    (old.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year_month")
     .parquet(archive_path))
    fs, _ = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    for m in months:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/year_month={m}"), True)
    return sorted(months)


STATE_BUCKETS = 64
RUNS_PER_LEVEL = 4
RETIRED = "_retired"


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def log_runs(spark: SparkSession, base: str, retired: bool = False) -> dict[int, list[str]]:
    """The runs of a change log by level, as folder paths: those in use, or those already merged
    into another run and kept for readers that began before. Names only, about
    ``RUNS_PER_LEVEL * log(batches)`` of them."""
    fs, _ = _fs(spark, base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found: dict[int, list[str]] = {}
    for run in fs.globStatus(path(f"{base.rstrip('/')}/level=*/batch=*")) or []:
        inside = {f.getPath().getName() for f in fs.listStatus(run.getPath())}
        if any(n.startswith("bucket=") for n in inside) and (RETIRED in inside) == retired:
            own = run.getPath()
            found.setdefault(int(own.getParent().getName().split("=")[1]), []).append(own.toString())
    return {level: sorted(runs) for level, runs in sorted(found.items())}


def _read_runs(spark: SparkSession, base: str, runs: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", True).option("basePath", base).parquet(*runs)


def _write_run(rows: DataFrame, base: str, level: int, name: str, keys: list[str], buckets: int) -> None:
    """One run: latest rows by key bucket, sorted by key. Written again, it replaces itself."""
    (rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).sortWithinPartitions("bucket", *keys)
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{base.rstrip('/')}/level={level}/batch={name}"))


def upsert(spark: SparkSession, base: str, batch: DataFrame, keys: list[str], order: list[Column],
           batch_id: str | int | None = None, buckets: int = STATE_BUCKETS, run: str = "",
           fan: int | None = RUNS_PER_LEVEL) -> str:
    """Add a batch's changes to the log below ``base``; returns the batch name.

    Of several changes of one key in the batch only the latest by ``order`` is kept. A batch is
    named by ``run`` (the identity of the stream or job that numbers its batches) and
    ``batch_id``: written again under the same name it replaces itself, and another run's batches
    with the same numbers stay apart. Then full levels are merged (``compact_levels``; None: not
    now), so a row is rewritten about log(batches) times over the life of the log."""
    name = f"b{uuid.uuid4().hex}" if batch_id is None else f"b{run}-{batch_id}"
    _write_run(latest_per_key(batch, keys, order), base, 0, name, keys, buckets)
    if fan:
        compact_levels(spark, base, keys, order, fan, buckets)
    return name


def read_log(spark: SparkSession, base: str) -> DataFrame | None:
    """All rows of the change log, tombstones included; columns that a batch lacks are null."""
    runs = [r for level in log_runs(spark, base).values() for r in level] if _exists(spark, base) else []
    return _read_runs(spark, base, runs) if runs else None


def read_state(spark: SparkSession, base: str, keys: list[str], order: list[Column],
               delete_col: str | None = None) -> DataFrame | None:
    """Latest row per key by ``order`` over the runs in use, without keys whose latest row is a tombstone."""
    log = read_log(spark, base)
    if log is None:
        return None
    win = latest_per_key(log.drop("level", "batch", "bucket"), keys, order)
    return win.filter(~F.coalesce(F.col(delete_col), F.lit(False))) if delete_col else win


def compact_levels(spark: SparkSession, base: str, keys: list[str], order: list[Column],
                   fan: int = RUNS_PER_LEVEL, buckets: int = STATE_BUCKETS) -> list[str]:
    """Merge every level that holds ``fan`` runs into one run of the next level; returns the new runs.

    Only the runs of that level are read, the latest row per key is kept, tombstones too. A crash at
    any step leaves a right table: the rows of a half-written run are true changes that
    its inputs still hold, and rows found twice change no latest row. Merged runs are marked and deleted
    by the next call, so a reader that listed them before can still read them. One writer at a time
    may merge a log."""
    fs, _ = _fs(spark, base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for runs in log_runs(spark, base, retired=True).values():
        for r in runs:
            fs.delete(path(r), True)
    written = []
    while True:
        level, runs = next(((lv, r) for lv, r in log_runs(spark, base).items() if len(r) >= fan), (None, []))
        if level is None:
            return written
        name = "m" + hashlib.sha1("\n".join(r.rsplit("/", 1)[1] for r in runs).encode()).hexdigest()[:20]
        rows = _read_runs(spark, base, runs).drop("level", "batch", "bucket")
        _write_run(latest_per_key(rows, keys, order), base, level + 1, name, keys, buckets)
        written.append(f"{base.rstrip('/')}/level={level + 1}/batch={name}")
        for r in runs:
            fs.create(path(f"{r}/{RETIRED}"), True).close()


def compact_state(spark: SparkSession, base: str, keys: list[str], order: list[Column]) -> None:
    """Merge all runs into one a level above them, whatever their number (maintenance by hand)."""
    levels = log_runs(spark, base)
    runs = [r for level in levels.values() for r in level]
    if len(runs) < 2:
        return
    fs, _ = _fs(spark, base)
    rows = _read_runs(spark, base, runs).drop("level", "batch", "bucket")
    _write_run(latest_per_key(rows, keys, order), base, max(levels) + 1, f"m{uuid.uuid4().hex[:20]}", keys, STATE_BUCKETS)
    for r in runs:
        fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{r}/{RETIRED}"), True).close()


def merge_partitions(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], order: list[Column],
                     part_col: str = "year_month") -> None:
    """Replay-safe merge of a batch into a partitioned table: only the partitions the
    batch touches are read, merged (latest per key) and rewritten (dynamic overwrite).
    Columns are matched by name; one that either side lacks is null there. Any failure to
    read the table ends the merge before a row is written."""
    merged = batch
    if _exists(spark, path):
        touched = batch.select(part_col).distinct()
        existing = spark.read.option("mergeSchema", True).parquet(path).join(F.broadcast(touched), part_col, "left_semi")  # partition names
        merged = existing.unionByName(batch, allowMissingColumns=True)
    merged = latest_per_key(merged, keys, order)
    ensure_checkpoint_dir(spark)
    merged = merged.checkpoint(eager=True)        # the write below replaces what was read
    (merged.repartitionByRange(part_col, *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(part_col).parquet(path))


def archive_run(df: DataFrame, base: str, run_date: str) -> None:
    """Per-run result archive under ``run_date=<date>``; a rerun replaces its own folder."""
    (df.withColumn("run_date", F.lit(run_date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_date").parquet(base))


def compact(spark: SparkSession, raw_path: str, dt: str, out_path: str, target_rows_per_file: int = 1_000_000) -> int:
    """Compact the hourly files of one day (``dt=<day>/hh=<hour>``) into a few daily
    files; the day's partition of the output is replaced. Returns the file count."""
    day = spark.read.parquet(raw_path).filter(F.col("dt") == dt)
    n = day.count()
    files = max(1, -(-n // target_rows_per_file))
    (day.drop("hh").repartition(files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dt").parquet(out_path))
    return files
