"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from payflow.llm import (decontaminate, html_crf, licenses, manifest, merkle, packing, quality, simhash, spelling,
                         token_files, toxicity, vector_search, warc)
from payflow.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _on(operator: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: operator(*(read_table(spark, sf_dir, t) for t in tables))


def llm_queries() -> dict[str, Query]:
    return {
        "op1_warc": _on(warc.archive_round_trip, "pages"),
        "op2_fingerprints": _on(merkle.edited_fingerprints, "documents"),
        "op3_decontamination": _on(decontaminate.contaminated, "documents", "benchmark"),
        "op4_token_counts": _on(token_files.document_token_counts, "documents"),
        "op5_licenses": _on(licenses.license_matches, "documents"),
        "op6_quality": _on(quality.quality_scores, "documents", "labels"),
        "op7_main_text": _on(html_crf.extract, "pages"),
        "op8_simhash": _on(simhash.near_duplicates, "documents"),
        "op9_toxicity": _on(toxicity.toxicity_scores, "documents", "labels"),
        "op10_packing": _on(packing.pack_documents, "documents"),
        "op11_spelling": _on(spelling.spelling_variants, "documents"),
        "op12_neighbours": _on(vector_search.nearest, "embeddings"),
        "op13_manifest": _on(manifest.dataset_manifest, "documents"),
    }


def llm_oracles() -> dict[str, str]:
    return {"op1_warc": warc.oracle_sql(), "op5_licenses": licenses.oracle_sql(),
            "op11_spelling": spelling.oracle_sql(), "op13_manifest": manifest.oracle_sql()}
