"""A simulated producer: metadata, health, then detections that go round timing points and subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START_NS = 1_700_000_000_000_000_000


def simulated(spark: SparkSession, count: int, detector: str = "sim-1", points: tuple[str, ...] = ("tp-start", "tp-finish"), subjects: tuple[str, ...] = ("car-1", "car-2", "car-3"), interval_ns: int = 2_000_000_000, start_ns: int = START_NS) -> DataFrame:
    """(emitted, kind, detector_id, timing_point_id, subject_id, sequence_number, at_ns): the stream of one detector."""
    ids = spark.range(count + 2).select(F.col("id").alias("emitted"))
    return _stream(ids, detector, points, subjects, interval_ns, start_ns)


def _stream(ids: DataFrame, detector: str, points: tuple[str, ...], subjects: tuple[str, ...], interval_ns: int, start_ns: int) -> DataFrame:
    e = F.col("emitted")
    n = e - 2
    kind = F.when(e == 0, "AdapterMetadata").when(e == 1, "DetectorHealth").otherwise("Detection")
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(n, F.lit(len(names))) + 1).cast("int")) if names else F.lit(None).cast("string")
    seen = e >= 2
    return ids.select(
        e, kind.alias("kind"), F.lit(detector).alias("detector_id"), F.when(seen, pick(points)).otherwise(points[0]).alias("timing_point_id"),
        F.when(seen, pick(subjects)).alias("subject_id"), F.when(seen, n).alias("sequence_number"), (F.greatest(n, F.lit(0)) * interval_ns + start_ns).alias("at_ns"),
    )


def simulated_stream(spark: SparkSession, rows_per_second: int = 1, **settings) -> DataFrame:
    """The same as an endless stream."""
    ids = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("value").alias("emitted"))
    defaults = {"detector": "sim-1", "points": ("tp-start", "tp-finish"), "subjects": ("car-1", "car-2", "car-3"), "interval_ns": 2_000_000_000, "start_ns": START_NS}
    return _stream(ids, **(defaults | settings))
