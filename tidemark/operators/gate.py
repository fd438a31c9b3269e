"""Sequence gate: drops what was seen, reports gaps, by producer and detector.

The high-water mark before a row is the running maximum of the sequence numbers before it, which is exact although
dropped rows count: they are at most the mark. The maximum is taken in two steps, over stretches of ``arrival`` and
within them, so that one busy detector is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("producer_id", "detector_id")
#: Arrivals that one stretch spans.
STRETCH = 1 << 20


def gate_decisions(detections: DataFrame, seed: DataFrame | None = None, stretch: int = STRETCH) -> DataFrame:
    """Adds ``high_water`` (before the row), ``expected``, ``missing`` and ``decision``.

    ``arrival`` must be unique. ``seed`` has (producer_id, detector_id, high_water) of an earlier run. Keys may be
    null: nulls are a key of their own.
    """
    part = F.expr(f"arrival div {stretch}")
    rows = detections.withColumn("_part", part)
    top = rows.groupBy(*KEY, "_part").agg(F.max("sequence_number").alias("_top"))
    over_parts = Window.partitionBy(*KEY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = top.withColumn("_before", F.max("_top").over(over_parts))
    if seed is not None:
        s = seed.select(*[F.col(k).alias(f"_s_{k}") for k in KEY], F.col("high_water").alias("_seed"))
        same = F.lit(True)
        for k in KEY:
            same = same & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
        before = before.join(s, same, "left").withColumn("_before", F.greatest("_before", "_seed"))
    before = before.where("_before IS NOT NULL").select(*[F.col(k).alias(f"_b_{k}") for k in KEY], F.col("_part").alias("_b_part"), "_before")
    same = F.col("_part") == F.col("_b_part")
    for k in KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    within = Window.partitionBy(*KEY, "_part").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("_in", F.max("sequence_number").over(within)).join(before, same, "left")
    marked = marked.withColumn("high_water", F.greatest("_in", "_before"))
    n, hw = F.col("sequence_number"), F.col("high_water")
    decision = F.when(hw.isNull(), "Accept").when(n <= hw, "Duplicate").when(n == hw + 1, "Advance").otherwise("Gap")
    marked = marked.withColumn("decision", decision)
    gap = F.col("decision") == "Gap"
    return marked.select(*detections.columns, "high_water", F.when(gap, hw + 1).alias("expected"), F.when(gap, n - hw - 1).alias("missing"), "decision")


def accepted(decided: DataFrame) -> DataFrame:
    """What is stored: all but duplicates."""
    return decided.where("decision <> 'Duplicate'")


def high_water(log_detections: DataFrame) -> DataFrame:
    """(producer_id, detector_id, high_water): what a restart seeds the gate with."""
    return log_detections.groupBy(*KEY).agg(F.max("sequence_number").alias("high_water"))
