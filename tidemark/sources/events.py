"""Detections from the events table: sequence numbers with gaps, and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The grouping window that fits these events, three days.
WINDOW_NS = 259_200_000_000_000
#: Event ids that one task numbers.
STRETCH = 1 << 18


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def from_events(events: DataFrame) -> DataFrame:
    """Detections with producer_id and arrival; every 50th sequence number is left out, every 17th event comes twice."""
    e, kind = F.col("event_id"), F.col("event_type")
    rows = _numbered(events).select("event_id", "event_type", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"), "rn")
    loop = kind.isin("click", "view")
    rssi = F.when(loop & (e % 5 != 0), F.floor("value").cast("long") % 70 - 100).cast("smallint")
    what = F.when(loop, "LoopTransponder").when(kind == "purchase", "Manual").otherwise("BeamBreak")
    made = rows.select(
        F.concat(F.lit("d-"), e.cast("string")).alias("detection_id"),
        F.concat(F.lit("prod-"), kind).alias("producer_id"),
        F.concat(F.lit("det-"), kind).alias("detector_id"),
        F.concat(F.lit("tp-"), kind).alias("timing_point_id"),
        F.when(kind != "error", F.concat(F.lit("subj-"), F.col("user_id").cast("string"))).alias("subject_id"),
        (F.unix_micros("ts") * 1000).alias("detected_at_ns"),
        F.when(e % 3 != 0, e % 7 * 1_000_000).alias("detected_at_uncertainty_ns"),
        F.lit(None).cast("long").alias("received_at_ns"),
        F.lit("HardwareEventCapture").alias("timestamping_method"),
        F.concat(F.lit("tb-"), (e % 3).cast("string")).alias("timebase_id"),
        F.when(e % 2 == 0, "RuntimeDiscovered").otherwise("OperatorAsserted").alias("source_attestation"),
        (F.col("rn") + F.floor(F.col("rn") / 50.0).cast("long")).alias("sequence_number"),
        F.struct(what.alias("kind"), rssi.alias("rssi_dbm"), F.lit(None).cast("bigint").alias("pulse_count"), F.lit(None).cast("string").alias("operator_id")).alias("sensor"),
        F.explode(F.when(e % 17 == 0, F.array(e * 2, e * 2 + 41)).otherwise(F.array(e * 2))).alias("arrival"),
    )
    return made


def _numbered(events: DataFrame) -> DataFrame:
    """Adds ``rn``, an event's number from 1 among those of its type, by stretches of ids: a type is many tasks' work."""
    part = F.expr(f"event_id div {STRETCH}")
    counts = events.groupBy("event_type", part.alias("_part")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("event_type").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("event_type").alias("_type"), F.col("_part").alias("_b"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    k = F.row_number().over(Window.partitionBy("event_type", "_part").orderBy("event_id"))
    same = F.col("event_type").eqNullSafe(F.col("_type")) & F.col("_part").eqNullSafe(F.col("_b"))
    return events.withColumn("_part", part).withColumn("_k", k).join(before, same).withColumn("rn", F.col("_before") + F.col("_k"))
