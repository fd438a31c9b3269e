"""Defaults that a producer's builder fills in, and sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: str = "arrival") -> DataFrame:
    """Sequence numbers from 0 by detector, in order, where none is given."""
    w = Window.partitionBy("detector_id").orderBy(order)
    return rows.withColumn("sequence_number", (F.row_number().over(w) - 1).cast("long"))


def normalised(rows: DataFrame, now: Column) -> DataFrame:
    """Detections with every field that a builder would set; ``now`` is nanoseconds, given so that tests can fix it."""
    have = set(rows.columns)
    field = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    sensor = "struct<kind:string,rssi_dbm:smallint,pulse_count:bigint,operator_id:string>"
    loop = F.struct(F.lit("LoopTransponder").alias("kind"), F.lit(None).cast("smallint").alias("rssi_dbm"), F.lit(None).cast("bigint").alias("pulse_count"), F.lit(None).cast("string").alias("operator_id"))
    ident = F.concat_ws("-", "detector_id", F.col("sequence_number").cast("string"))
    defaults = {
        "detection_id": F.coalesce(field("detection_id", "string"), ident),
        "subject_id": field("subject_id", "string"),
        "detected_at_uncertainty_ns": field("detected_at_uncertainty_ns", "bigint"),
        "received_at_ns": F.coalesce(field("received_at_ns", "bigint"), now),
        "timestamping_method": F.coalesce(field("timestamping_method", "string"), F.lit("AdapterReceiveTime")),
        "timebase_id": F.coalesce(field("timebase_id", "string"), F.lit("local")),
        "source_attestation": F.coalesce(field("source_attestation", "string"), F.lit("OperatorAsserted")),
        "sensor": F.coalesce(field("sensor", sensor), loop),
    }
    return rows.withColumns(defaults)
