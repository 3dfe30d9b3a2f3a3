"""Materialized marts: the star is built once and written as Parquet tables.

Reports then read tables, not the lineage that built them: the plan of a report is
a scan with pushed filters and pruned columns, and a lost executor recomputes from
the written files instead of replaying the whole build. The tables live in the
shared folder named by ``spark.checkpoint.dir`` (set by the cluster; tests set a
scratch one only when it is unset).
"""

from __future__ import annotations

import hashlib
import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payflow.plans.bindings import Views
from payflow.plans.marts import Marts
from payflow.session import ensure_checkpoint_dir
from payflow.sources.sinks import write_transactions

# mart name -> columns to sort rows by inside each file (zone maps for range filters)
TABLES = {
    "dim_date": ["date_sk"],
    "dim_geography": ["geography_sk"],
    "dim_currency": ["currency_sk"],
    "dim_payment_method": ["payment_method_sk"],
    "dim_product": ["product_sk"],
    "dim_merchant": ["merchant_sk"],
    "dim_customer_base": ["customer_sk"],
    "fact_transactions": ["date_sk"],
    "dim_customer": ["customer_sk"],
    "fact_audit_events": ["date_sk"],
    "agg_daily_revenue": ["date_sk"],
    "agg_monthly_fraud": ["year_month"],
    "mv_monthly_revenue_by_country": ["year", "month"],
}

_lock = threading.Lock()
_built: dict[tuple[str, str], "StoredMarts"] = {}


INPUTS = ["nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events"]


def input_state(spark: SparkSession, sf_dir: str) -> str:
    """Digest of the input tables' files (path, length, time of change), from their folder
    listing: what is kept under it is not used again once an input has changed."""
    jvm = spark.sparkContext._jvm
    seen = []
    for name in INPUTS:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            seen += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in fs.listStatus(path)]
    return hashlib.sha1("\n".join([sf_dir.rstrip("/"), *sorted(seen)]).encode()).hexdigest()[:12]


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, input_state(spark, sf_dir)


def _root(spark: SparkSession, key: tuple[str, str]) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/payflow-marts/{key[0]}/{key[1]}"


class StoredMarts(Marts):
    """A ``Marts`` whose tables are read from their written Parquet copies."""

    def __init__(self, views: Views, root: str):
        super().__init__(views)
        self.root = root
        for name in TABLES:
            # instance attribute shadows the cached_property that would rebuild the lineage
            self.__dict__[name] = views.spark.read.parquet(f"{root}/{name}")


# build waves: tables of one wave depend only on earlier waves and are built concurrently
WAVES = [
    ["dim_date", "dim_geography", "dim_currency", "dim_payment_method", "dim_product", "dim_merchant",
     "dim_customer_base", "fact_audit_events"],
    ["fact_transactions"],
    ["dim_customer", "agg_daily_revenue", "agg_monthly_fraud", "mv_monthly_revenue_by_country"],
]


def write_marts(m: Marts, root: str, parallel: int = 8) -> None:
    """Build and write every mart in dependency order; each table is read back before the
    next wave uses it, so no plan repeats the build of an earlier table. Independent
    tables of a wave are submitted as concurrent Spark jobs (the scheduler interleaves
    their tasks on the same executors)."""
    spark = m.v.spark

    def build(name: str) -> DataFrame:
        df: DataFrame = getattr(m, name)
        df.sortWithinPartitions(*TABLES[name]).write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        for wave in WAVES:
            done = dict(zip(wave, pool.map(build, wave)))
            m.__dict__.update(done)


_views: dict[tuple[str, str], Views] = {}
_vlock = threading.Lock()


def stored_views(spark: SparkSession, sf_dir: str) -> Views:
    """Payment views whose staged ``tx`` table is written once per application (it feeds
    about ten marts and most reports; without it each would redo orders x customer)."""
    key = _key(spark, sf_dir)
    with _vlock:
        if key not in _views:
            v = Views(spark, sf_dir)
            path = f"{_root(spark, key)}/tx"
            v.tx.write.mode("overwrite").parquet(path)
            v.__dict__["tx"] = spark.read.parquet(path)
            _views[key] = v
        return _views[key]


_months: dict[tuple[str, str], DataFrame] = {}
_molock = threading.Lock()


def stored_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payments partitioned by month (``sinks.write_transactions``), for reports that prune by it."""
    key = _key(spark, sf_dir)
    with _molock:
        if key not in _months:
            path = f"{_root(spark, key)}/tx_by_month"
            write_transactions(stored_views(spark, sf_dir).tx, path)
            _months[key] = spark.read.parquet(path)
        return _months[key]


LANDED_ROWS = 250_000                  # a compressed file is read by one task, so its rows are bounded
_messages: dict[tuple[str, str], DataFrame] = {}
_mlock = threading.Lock()


def landed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change messages of the payments, landed once as JSON lines and read as any landed folder is."""
    from payflow.plans.jobs import cdc_messages
    from payflow.sources.readers import read_cdc
    key = _key(spark, sf_dir)
    with _mlock:
        if key not in _messages:
            path = f"{_root(spark, key)}/landing"
            (cdc_messages(stored_views(spark, sf_dir)).write.mode("overwrite").option("compression", "gzip")
             .option("maxRecordsPerFile", LANDED_ROWS).json(path))
            _messages[key] = read_cdc(spark, path)
        return _messages[key]


_streams: dict[tuple[str, str], str] = {}
_slock = threading.Lock()


def document_streams(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the states that the document change streams keep: changes are landed once, and
    both streams are run over all of them (``sessions`` and ``feedback`` below the folder)."""
    from payflow.plans import documents as DC
    key = _key(spark, sf_dir)
    with _slock:
        if key not in _streams:
            root = f"{_root(spark, key)}/documents"
            DC.document_changes(stored_views(spark, sf_dir)).write.mode("overwrite").text(f"{root}/landing")
            runs = [DC.run_session_stream(spark, f"{root}/landing", f"{root}/sessions", f"{root}/ck-sessions"),
                    DC.run_feedback_stream(spark, f"{root}/landing", f"{root}/feedback", f"{root}/dead", f"{root}/ck-feedback")]
            for q in runs:
                q.awaitTermination()
            _streams[key] = root
        return _streams[key]


_deltas: dict[tuple[str, str], str] = {}
_dlock = threading.Lock()


def revenue_deltas(spark: SparkSession, sf_dir: str, batches: int = 3) -> str:
    """Folder of the daily revenue deltas that the landed changes leave in about ``batches`` micro-batches."""
    from payflow.streaming.marts import run_marts_stream
    key = _key(spark, sf_dir)
    files = len(landed_messages(spark, sf_dir).inputFiles())
    with _dlock:
        if key not in _deltas:
            root = f"{_root(spark, key)}/revenue"
            run_marts_stream(spark, f"{_root(spark, key)}/landing", f"{root}/state", f"{root}/deltas", f"{root}/ck",
                             max(1, -(-files // batches))).awaitTermination()
            _deltas[key] = f"{root}/deltas"
        return _deltas[key]


def stored_marts(spark: SparkSession, sf_dir: str) -> StoredMarts:
    """The materialized star for ``sf_dir`` (built on first use in this application)."""
    key = _key(spark, sf_dir)
    with _lock:
        if key not in _built:
            root = _root(spark, key)
            views = stored_views(spark, sf_dir)
            write_marts(Marts(views), root)
            _built[key] = StoredMarts(views, root)
        return _built[key]


_features: dict[tuple[str, str], DataFrame] = {}
_flock = threading.Lock()


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materialized feature documents (the feature store) for ``sf_dir``. Built from the
    views only, so it does not wait for the star (see ``build_all``)."""
    from payflow.plans.features import ml_features
    key = _key(spark, sf_dir)
    with _flock:
        if key not in _features:
            path = f"{_root(spark, key)}/ml_features"
            ml_features(stored_views(spark, sf_dir)).sortWithinPartitions(F.col("computed_at")) \
                .write.mode("overwrite").parquet(path)
            _features[key] = spark.read.parquet(path)
        return _features[key]


def build_all(spark: SparkSession, sf_dir: str) -> None:
    """Star and feature store built as two concurrent job streams."""
    stored_views(spark, sf_dir)
    with ThreadPoolExecutor(max_workers=2) as pool:
        futs = [pool.submit(stored_marts, spark, sf_dir), pool.submit(stored_features, spark, sf_dir)]
        for f in futs:
            f.result()
