"""The corpus pipeline: quality, exact dedup, near-dedup, personal data, packing, each stage on what the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.exact import exact_dedup
from tidemark.llm.packing import best_fit_packing
from tidemark.llm.pii import pii_redact
from tidemark.llm.quality import quality_filter
from tidemark.llm.shared import drop, made, written
from tidemark.llm.simhash import near_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. The ratings in ``labels`` belong to the documents as they are here.

    Null texts go; empty ones are graded by the thresholds alone; long ones are read whole. Equal texts have one grade,
    so ties and repeated rows stay or go together; null ids stay if their text is accepted. Without documents there are no
    rows, without ratings none is accepted. All columns come out, whatever their names."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the smallest id, null ids last, then by the hash of the row.

    Null texts all stay, one of the empty ones; long texts are compared whole; of repeated rows one stays. An empty table
    gives no rows; all columns come out, whatever their names."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Null texts, texts without words and rows without id stay; long texts are read whole; rows with one id are decided by
    their texts, repeated rows of a keeper stay (the stage before leaves none). An empty table gives no rows; all columns
    come out, whatever their names."""
    return near_dedup(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, and ``n_chars`` set where the text was changed.

    Null and empty texts stay as they are; long ones are searched whole; of overlapping proposals the first kind's counts;
    repeated rows and null ids come out one for one. An empty table gives no rows; all columns come out, whatever their
    names."""
    return pii_redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: (doc_id, start, length, bin_id, bin_offset).

    Null and empty texts have a row without bin; long ones are cut into full pieces and a rest; pieces of equal length go
    by the hash of id and start, then id; repeated rows and null ids are packed as others. An empty table gives no rows;
    other columns are not read, whatever their names."""
    return best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]

#: SQL can't express the classifier, SimHash groups, span classifier and greedy packing; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder as Parquet and read again. What a
    stage was made from is removed when it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = made()
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        drop(mark)
    return STAGES[-1][1](spark, docs, sf_dir)
