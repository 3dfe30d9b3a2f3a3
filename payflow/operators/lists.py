"""Delimited id lists per group (SQL ``STRING_AGG``) with a bound on every list.

A plain ``collect_list`` merges the whole group into one row in one task: a key that
holds a third of the rows would hold a third of the ids in one task's memory. Here
the values of a group are numbered in list order with ``group_row_number`` (which
splits a hot group across tasks), cut into chunks of at most ``chunk`` values, and
one string is built per (group, chunk). Every value appears exactly once; a group
with at most ``chunk`` values is a single row with ``id_chunk = 0``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payflow.operators.ranks import group_row_number

CHUNK = 1000


def chunked_string_agg(df: DataFrame, keys: list[str], value: Column, name: str, sep: str = ", ",
                       chunk: int = CHUNK, chunk_col: str = "id_chunk") -> DataFrame:
    """Rows (keys, ``chunk_col``, ``name``): ``value`` strings of each group joined by ``sep`` in
    ascending string order, at most ``chunk`` per row. Values must be unique within a group
    (apply ``distinct`` first for ``STRING_AGG(DISTINCT ...)``)."""
    vals = df.select(*keys, value.cast("string").alias("_s"))
    numbered = group_row_number(vals, keys, ["_s"], "_pos")
    return (numbered.groupBy(*keys, ((F.col("_pos") - 1) / chunk).cast("long").alias(chunk_col))
            .agg(F.array_join(F.array_sort(F.collect_list("_s")), sep).alias(name)))
