"""Intermediate tables in the shared folder.

A loop that joins its own results over and over should cut its plan with written tables:
they have true sizes, while the estimates of a checkpointed plan multiply with every join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from payflow.session import ensure_checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
