"""From raw documents to packed sequences: every stage applies one operator to all it gets.

Rows: null and empty texts pass the classifiers or not by their score as empty texts, are near duplicates of
each other (one of them stays) and are packed as their end id alone. Of repeated rows one stays. Rows with a null
doc_id are kept apart from the others; of a group of only such rows one stays. Without labels nothing is rejected
by the classifiers; without a benchmark nothing is contaminated; an empty documents table gives no pieces. Extra columns
of documents, clashing names included, pass every stage but the last, which returns the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from payflow.llm import decontaminate, packing, quality, simhash, toxicity
from payflow.llm.common import read_table, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_duplicates", distinct_documents),
          ("decontamination", decontaminated), ("packing", packed)]

#: The stages hash, learn and tokenise, which DuckDB SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
