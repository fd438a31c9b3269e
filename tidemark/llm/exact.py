"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary of text digests finds the frequent ones. Their winners (smallest id, whole text, compared byte
by byte) are broadcast, so that their copies go away where they are read; all other rows are shuffled by SHA-256.
The summary and the broadcast are bounded (``heavy`` digests, ``winner_bytes`` of text); what they leave out takes
the shuffle, so results don't depend on the bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import may_be_in, written


def misra_gries(summary: tuple[np.ndarray, np.ndarray], digests: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Adds digests to a summary of at most ``k`` counters; counts are low by at most n / (k + 1)."""
    values, counts = np.unique(digests, return_counts=True)
    values, place = np.unique(np.concatenate((summary[0], values)), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate((summary[1], counts))).astype(np.int64)
    if len(values) > k:
        counts = counts - np.partition(counts, len(counts) - k - 1)[len(counts) - k - 1]
        values, counts = values[counts > 0], counts[counts > 0]
    return values, counts


def frequent(digests: DataFrame, k: int) -> DataFrame:
    """(digest, at_least): every value of the one long column that makes up more than 1 / (k + 1) of the rows, and others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            summary = misra_gries(summary, batch.column(0).to_numpy(zero_copy_only=False), k)
        yield pa.RecordBatch.from_arrays([pa.array(summary[0]), pa.array(summary[1])], names=["digest", "at_least"])

    return digests.mapInArrow(run, "digest long, at_least long").groupBy("digest").agg(F.sum("at_least").alias("at_least"))


def heavy_winners(texts: DataFrame, heavy: int, copies: int, winner_bytes: int) -> DataFrame | None:
    """(_h, _winner_text, _winner) of the frequent texts of (_id, _text, _h), as far as they fit; None if there are none."""
    top = frequent(texts.where("_text IS NOT NULL").select("_h"), heavy).where(F.col("at_least") >= copies)
    found = [r.digest for r in top.orderBy(F.desc("at_least"), "digest").limit(heavy).collect()]
    if not found:
        return None
    rows = texts.where(F.col("_h").isin(found)).groupBy("_h", F.col("_text").alias("_winner_text")).agg(F.min("_id").alias("_winner"), F.count("*").alias("_n"))
    size = F.sum(F.octet_length("_winner_text") + 64).over(Window.orderBy(F.desc("_n"), "_h", "_winner").rowsBetween(Window.unboundedPreceding, 0))
    return written(rows.where(F.col("_n") >= copies).withColumn("_size", size).where(F.col("_size") <= winner_bytes).select("_h", "_winner_text", "_winner"))


def _marked(docs: DataFrame, doc_id: str, text: str, heavy: int, copies: int, winner_bytes: int) -> DataFrame:
    """(_row, _id, _text, _winner): _winner is set for copies of a frequent text that another row with a smaller id has."""
    packed = docs.select(F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row"), docs[doc_id].alias("_id"), docs[text].alias("_text"))
    rows = packed.withColumn("_h", F.xxhash64("_text"))
    winners = heavy_winners(rows.select("_id", "_text", "_h"), heavy, copies, winner_bytes)
    if winners is None:
        return rows.withColumn("_winner", F.lit(None).cast(rows.schema["_id"].dataType))
    w = F.broadcast(winners.withColumnRenamed("_h", "_wh"))
    loses = (F.col("_h") == F.col("_wh")) & (F.col("_text") == F.col("_winner_text")) & (F.col("_id").isNull() & F.col("_winner").isNotNull() | (F.col("_id") > F.col("_winner")))
    return rows.join(w, loses, "left").drop("_wh", "_winner_text")


def _rank(columns: list[Column]) -> tuple[Column, Column]:
    w = Window.partitionBy("_digest").orderBy(F.col("_id").asc_nulls_last(), *columns)
    return F.row_number().over(w), F.first("_id").over(w)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy: int = 256, copies: int = 32, winner_bytes: int = 32 << 20) -> DataFrame:
    """The decision on every row: (doc_id, keeper_id, is_duplicate); texts are copies if their bytes are equal.

    The row with the smallest id of each text is kept (a null id comes last; of repeated rows one). A null text is no
    copy of anything; empty texts are copies of each other. Other columns are not read, whatever their names; an empty
    table gives no rows.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keys = written(_marked(own, "doc_id", "text", heavy, copies, winner_bytes).select("_id", "_winner", F.when(F.col("_winner").isNull(), F.unhex(F.sha2("_text", 256))).alias("_digest")))
    lost = keys.where("_winner IS NOT NULL").select(F.col("_id").alias("doc_id"), F.col("_winner").alias("keeper_id"), F.lit(True).alias("is_duplicate"))
    alone = keys.where("_winner IS NULL AND _digest IS NULL").select(F.col("_id").alias("doc_id"), F.col("_id").alias("keeper_id"), F.lit(False).alias("is_duplicate"))
    place, keeper = _rank([])
    rest = keys.where("_winner IS NULL AND _digest IS NOT NULL").select(F.col("_id").alias("doc_id"), keeper.alias("keeper_id"), (place > 1).alias("is_duplicate"))
    return lost.unionByName(alone).unionByName(rest)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy: int = 256, copies: int = 32, winner_bytes: int = 32 << 20, most_sent: int = 4 << 20) -> DataFrame:
    """The rows that exact_duplicates keeps, with all columns of the input, whatever their names. Ties on the id go by
    the hash of the row; null texts all stay, of empty ones one; texts of any length are compared whole; an empty table
    gives no rows.

    Only texts whose 64-bit digest occurs more than once are shuffled. The list of these digests is broadcast up to
    ``most_sent`` of them (8 bytes each); of a longer one a Bloom filter is, which lets few others through.
    """
    rows = _marked(docs, doc_id, text, heavy, copies, winner_bytes).where("_winner IS NULL")
    contested = written(rows.where("_text IS NOT NULL").groupBy("_h").count().where("count > 1").select(F.col("_h").alias("_ch")))
    here, n = F.col("_h") == F.col("_ch"), contested.count()
    if n <= most_sent:
        shared, others = (rows.join(F.broadcast(contested), here, how) for how in ("left_semi", "left_anti"))
    else:
        told = rows.withColumn("_may", may_be_in(contested, n, F.col("_h")))
        shared, others = told.where("_may"), told.where("NOT _may")
    digest = F.when(F.col("_text").isNotNull(), F.unhex(F.sha2("_text", 256)))
    # A null text gets a digest of its own kind from the row's place, as it is no copy of anything.
    single = F.coalesce(digest, F.concat(F.lit(b"null"), F.encode(F.monotonically_increasing_id().cast("string"), "utf-8")))
    place, _ = _rank([F.xxhash64("_row")])
    kept = shared.select("_row", "_id", single.alias("_digest")).withColumn("_place", place).where("_place = 1").select("_row")
    kept = kept.unionByName(others.select("_row"))
    return kept.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
