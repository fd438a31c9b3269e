"""Tables written to the folder that all executors share, to cut lineage and to reread small intermediate results."""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one if Spark runs on this machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, options: dict | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again; it is removed when Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **{k: str(v) for k, v in (options or {}).items()}).parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many scratch tables there are; a mark for ``drop``."""
    return len(_made)


def drop(since: int, last: int = 1) -> None:
    """Removes the scratch tables made since a mark, but for the last ones; whoever calls knows that they were read."""
    gone = _made[since : len(_made) - last]
    del _made[since : len(_made) - last]
    for spark, path in gone:
        _delete(spark, path)


class Members:
    """Which values may be in a list of longs that is too long to send: a Bloom filter of bounded size.

    A value of the list is always said to be in it; another one seldom (1 in 1000 with 16 bits a value, more often where
    ``most_bits`` leaves fewer), so whoever asks looks again at what passes. Bits are set where the values are; what
    comes to the driver is the filter, not the list.
    """

    def __init__(self, values: DataFrame, n: int, most_bits: int):
        self.bits = 1 << min(max(10, math.ceil(math.log2(16 * max(n, 1)))), int(math.log2(most_bits)))
        self.words = np.zeros(self.bits >> 6, np.uint64)
        bits = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = np.unique(np.concatenate(_places(batch.column(0).to_numpy(zero_copy_only=False), bits)))
                yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], names=["word", "bit"])

        made = values.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.words[made.column("word").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)

    def may_have(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for place in _places(values, self.bits):
            out &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)) > 0
        return out


def _places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        x = values.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        y = (x >> np.uint64(32)) | np.uint64(1)
        return [(x + np.uint64(k) * y) & np.uint64(bits - 1) for k in range(7)]


def may_be_in(values: DataFrame, n: int, value: Column, most_bits: int = 1 << 30) -> Column:
    """Whether a long may be among the ``n`` values of the one column, told where the rows are (see Members)."""
    sent = values.sparkSession.sparkContext.broadcast(Members(values, n, most_bits))

    @F.arrow_udf("boolean")
    def told(column: pa.Array) -> pa.Array:
        return pa.array(sent.value.may_have(column.to_numpy(zero_copy_only=False)))

    return told(value)


def sampled(df: DataFrame, keys: list[str], most: int, n: int) -> DataFrame:
    """About ``most`` of the ``n`` rows, by the hash of their keys, all if there are no more. The filter runs where the
    rows are, so what is left is bounded before anything is moved."""
    if n <= most:
        return df
    return df.where(F.xxhash64(*keys).bitwiseAND((1 << 62) - 1) < int(0.97 * most / n * (1 << 62)))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the JVM may have ended
            _delete(spark, path)
