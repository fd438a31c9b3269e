"""The engine's tables as temporary views, for SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import metrics
from ..operators.crossings import DEFAULT_WINDOW_NS
from .service import ingest


def register(spark: SparkSession, detections: DataFrame, window_ns: int = DEFAULT_WINDOW_NS) -> list[str]:
    """detections, gate, crossings, log, events_appended, duplicates_dropped, sequence_gaps; all lazy."""
    made = ingest(detections, window_ns)
    views = {
        "detections": detections, "gate": made.decided, "crossings": made.crossings, "log": made.log, "events_appended": metrics.events_appended(made.log),
        "duplicates_dropped": metrics.duplicates_dropped(made.decided), "sequence_gaps": metrics.sequence_gaps(made.decided),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
