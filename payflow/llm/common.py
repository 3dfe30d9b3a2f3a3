"""Shared folder, stored intermediates and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` that driver and executors share.

    Only a local session may lack that setting (tests); it then gets a scratch folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="payflow-shared-")
    return f"{base.rstrip('/')}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back (lineage is cut)."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """One row per labelled doc_id: (doc_id, y). Null ids or labels do not count; of
    contradicting repeated rows the majority decides, a tie counts as 1."""
    return (labels.select("doc_id", F.col(column).cast("double").alias("_y"))
            .where(F.col("doc_id").isNotNull() & F.col("_y").isNotNull())
            .groupBy("doc_id").agg((F.avg("_y") >= 0.5).cast("int").alias("y")))


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of consecutive items whose sizes sum to about ``most`` at most, one item at least."""
    start = total = i = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if total or start <= i:
        yield start, i + 1
