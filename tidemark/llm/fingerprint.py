"""Canonical exact fingerprints: Unicode NFKC, case folding and white-space folding, 128-bit xxhash, bytes compared."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import byte_slices
from .shared import Members, written


def canonical(text: str) -> str:
    """NFKC, case folding, NFKC again as folding may undo it, and single spaces between words."""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def fingerprint(text: str) -> bytes:
    return xxhash.xxh3_128_digest(canonical(text).encode("utf-8", "surrogatepass"))


def _digests(docs: DataFrame, width: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in byte_slices(batch):
                digests = [None if t is None else fingerprint(t)[:width] for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(digests, pa.binary())], names=["doc_id", "digest"])

    return docs.mapInArrow(run, f"doc_id {kind}, digest binary")


def _halves(digests: list[bytes | None]) -> np.ndarray:
    return np.frombuffer(b"".join((d or b"")[:8].ljust(8, b"\0") for d in digests), ">i8").astype(np.int64)


def _canonical_of(docs: DataFrame, among: np.ndarray | Members, width: int) -> DataFrame:
    """(doc_id, digest, canon) of the rows whose digest's first 8 bytes are among the sorted values, or may be."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in byte_slices(batch):
                texts = [None if t is None else canonical(t).encode("utf-8", "surrogatepass") for t in piece.column("text").to_pylist()]
                digests = [None if t is None else xxhash.xxh3_128_digest(t)[:width] for t in texts]
                half, known = _halves(digests), sent.value
                if isinstance(known, Members):
                    keep = known.may_have(half)
                else:
                    at = np.minimum(np.searchsorted(known, half), max(len(known) - 1, 0))
                    keep = (known[at] == half) if len(known) else np.zeros(len(half), bool)
                where = [k for k in np.flatnonzero(keep).tolist() if digests[k] is not None]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(where, pa.int64())), pa.array([digests[k] for k in where], pa.binary()), pa.array([texts[k] for k in where], pa.binary())], names=["doc_id", "digest", "canon"])

    return docs.mapInArrow(run, f"doc_id {kind}, digest binary, canon binary")


def document_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_sent: int = 4 << 20, width: int = 16, most_bits: int = 1 << 30) -> DataFrame:
    """Every row's fingerprint and group: (doc_id, fingerprint, group_id).

    ``fingerprint`` is the hexadecimal digest of the canonical text, ``group_id`` the smallest id whose canonical text
    has the same bytes: rows with equal digests are compared, so a collision doesn't join groups. Only texts of
    digests that occur more than once are moved; the list of these digests is sent to the executors up to
    ``most_sent`` values (8 bytes each), beyond that a Bloom filter of them of at most ``most_bits``, which lets few
    others through. A null text has a null fingerprint and its own id as group; empty and blank texts are equal; texts
    of any length are read whole; null ids are kept and no group's id unless it has no other; rows come out one for
    one. Other columns of the input are not read, whatever their names; an empty table gives no rows. ``width`` is how many bytes of the digest are
    used, all by default; groups are the same for any.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keys = written(_digests(own, width))
    several = keys.where("digest IS NOT NULL").groupBy("digest").count().where("count > 1").select("digest")
    several = written(several)
    n = several.count()
    half = several.select(F.conv(F.rpad(F.substring(F.hex("digest"), 1, 16), 16, "0"), 16, -10).cast("long").alias("half")).distinct()
    if n <= most_sent:
        found = _canonical_of(own, np.sort(half.toArrow().column("half").to_numpy()), width)
    else:
        found = _canonical_of(own, Members(half, n, most_bits), width)
    classes = written(found.groupBy("digest", "canon").agg(F.min("doc_id").alias("group_id")))
    per = classes.groupBy("digest").agg(F.count("*").alias("classes"), F.min("group_id").alias("group_id"))
    single = per.where("classes = 1").select("digest", "group_id")
    collided = per.where("classes > 1").select("digest")
    plain = keys.join(collided, "digest", "left_anti").join(single, "digest", "left")
    plain = plain.select("doc_id", F.lower(F.hex("digest")).alias("fingerprint"), F.coalesce("group_id", "doc_id").alias("group_id"))
    if collided.isEmpty():
        return plain
    apart = found.join(F.broadcast(collided), "digest", "left_semi").join(classes, ["digest", "canon"])
    return plain.unionByName(apart.select("doc_id", F.lower(F.hex("digest")).alias("fingerprint"), F.coalesce("group_id", "doc_id").alias("group_id")))
