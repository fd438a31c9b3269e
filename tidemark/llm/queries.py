"""The ten operators as queries over the tables of a folder, and DuckDB SQL where that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_encode
from .chat import chat_format
from .dac import token_codes
from .exact import exact_duplicates
from .fingerprint import document_fingerprints
from .licenses import license_spans
from .packing import best_fit_packing
from .pii import pii_spans
from .quality import quality_scores
from .simhash import near_duplicates


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _of_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": _of_documents(best_fit_packing),
        "op2_license_scans": _of_documents(license_spans),
        "op3_token_codes": _of_documents(token_codes),
        "op4_simhash_near_dedup": _of_documents(near_duplicates),
        "op5_byte_level_bpe": _of_documents(bpe_encode),
        "op6_exact_dedup": _of_documents(exact_duplicates),
        "op7_pii": _of_documents(pii_spans),
        "op8_quality_classifier": lambda spark, sf_dir: quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
        "op9_chat_formatting": lambda spark, sf_dir: chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
        "op10_document_fingerprints": _of_documents(document_fingerprints),
    }


ORACLE_SQL = {
    "op6_exact_dedup": """
        SELECT doc_id,
               CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keeper_id,
               text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) > 1 AS is_duplicate
        FROM documents
    """,
    "op9_chat_formatting": """
        SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns,
               string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                          ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS formatted
        FROM conversations GROUP BY conv_id
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
