"""SparkSession factory with the settings every job in the package assumes."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "payflow", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session: UTC, AQE with skew handling, Arrow, UI off.

    On a cluster the master, ``spark.checkpoint.dir`` and the sizing settings come from
    the submit configuration and are kept. The shuffle partition count is, in order:
    ``shuffle_partitions`` (tests, bench), the submitted value, or three per executor
    core of the whole cluster (AQE coalesces small ones after each map stage; it can
    merge partitions but never add any, so the count must not come from the driver's
    own cores).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    forced = {
        # semantics and the execution model every job relies on
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.localShuffleReader.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.ansi.enabled": "false",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", "16g")      # this process launches the JVM itself
    defaults = {
        # Dimensions below this size are broadcast by the planner (from file statistics,
        # and again at runtime by AQE); larger ones fall back to a shuffle join.
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    }
    for k, v in {**forced, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    submitted = spark.sparkContext.getConf()
    for k, v in defaults.items():
        if not submitted.contains(k):
            spark.conf.set(k, v)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    elif not submitted.contains("spark.sql.shuffle.partitions"):
        spark.conf.set("spark.sql.shuffle.partitions", str(max(8, 3 * spark.sparkContext.defaultParallelism)))
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder. A scratch one is set only where it is unset and the
    session is local (tests): on a cluster each executor would write to its own disk."""
    cur = spark.sparkContext.getCheckpointDir()
    if cur:
        return cur
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = conf_dir or tempfile.mkdtemp(prefix="payflow-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path
