"""Queries that the event model invites but that are no part of the ingest path: lineage, as-of, federation, amendments, laps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def crossing_lineage(crossings: DataFrame, detections: DataFrame) -> DataFrame:
    """Each crossing with its detections in arrival order: (crossing_id, place, detection...)."""
    exploded = crossings.select("crossing_id", F.col("trigger_arrival"), F.posexplode("detection_ids").alias("place", "detection_id"))
    return exploded.join(detections, "detection_id")


def asof_timebase(detections: DataFrame, statuses: DataFrame, bucket_ns: int) -> DataFrame:
    """Each detection with the latest status of its timebase reported at or before it.

    Union and running last value by (timebase, stretch of time), with each stretch's last status carried over from a
    small table, so that a busy timebase is many tasks' work; no range join.
    """
    cols = detections.columns
    d = detections.select("timebase_id", F.col("detected_at_ns").alias("_t"), F.lit(1).alias("_side"), F.struct(*cols).alias("_d"), F.lit(None).cast("string").alias("_state"), F.lit(None).cast("long").alias("_at"))
    s = statuses.select("timebase_id", F.col("reported_at_ns").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(d.schema["_d"].dataType).alias("_d"), F.col("sync_state").alias("_state"), F.col("reported_at_ns").alias("_at"))
    both = d.unionByName(s).withColumn("_part", F.expr(f"_t div {bucket_ns}"))
    status = F.when(F.col("_side") == 0, F.struct("_at", "_state"))
    last = both.groupBy("timebase_id", "_part").agg(F.max(status).alias("_last"))
    over_parts = Window.partitionBy("timebase_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = last.withColumn("_carried", F.last("_last", True).over(over_parts)).select("timebase_id", "_part", "_carried")
    w = Window.partitionBy("timebase_id", "_part").orderBy("_t", "_side", "_at").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_now", F.last(status, True).over(w)).where("_side = 1").join(before, ["timebase_id", "_part"], "left")
    got = F.coalesce("_now", "_carried")
    return found.select("_d.*", got["_state"].alias("sync_state"), got["_at"].alias("status_at_ns"))


def federated(logs: dict[str, DataFrame]) -> DataFrame:
    """The logs of several nodes as one; ids become ``node:local``."""
    out = None
    for node, log in sorted(logs.items()):
        own = log.withColumns({"node_id": F.lit(node), "entry_id": F.concat_ws(":", F.lit(node), F.col("offset").cast("string")), "producer_id": F.concat_ws(":", F.lit(node), "producer_id")})
        out = own if out is None else out.unionByName(own)
    return out


def amended(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The latest version of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def laps(crossings: DataFrame) -> DataFrame:
    """Times between a subject's successive crossings of a point."""
    w = Window.partitionBy("timing_point_id", "subject_id").orderBy("crossed_at_ns", "crossing_id")
    lap = F.col("crossed_at_ns") - F.lag("crossed_at_ns").over(w)
    return crossings.where("subject_id IS NOT NULL").select("timing_point_id", "subject_id", "crossing_id", F.row_number().over(w).cast("long").alias("lap"), lap.alias("lap_ns"))


def discovered_only(detections: DataFrame) -> DataFrame:
    return detections.where("source_attestation = 'RuntimeDiscovered'")


def detector_registry(metadata: DataFrame) -> DataFrame:
    """The latest declaration of each detector."""
    return amended(metadata, "detector_id", "declared_at_ns")
