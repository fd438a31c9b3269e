"""Ingest metrics: labelled counters, a cardinality cap, and their text form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import escape_label_value
from ..schema import DERIVED_PRODUCER

MAX_SERIES = 10_000


def events_appended(log: DataFrame) -> DataFrame:
    """By producer and kind; crossings that the node made count for a producer of their own."""
    who = F.when(F.col("is_derived"), DERIVED_PRODUCER).otherwise(F.col("producer_id"))
    return log.groupBy(who.alias("producer_id"), F.col("kind").alias("event_kind")).agg(F.count("*").alias("value"))


def duplicates_dropped(decided: DataFrame) -> DataFrame:
    return decided.where("decision = 'Duplicate'").groupBy("producer_id", "detector_id").agg(F.count("*").alias("value"))


def sequence_gaps(decided: DataFrame) -> DataFrame:
    """Events past a gap, not missing numbers."""
    return decided.where("decision = 'Gap'").groupBy("producer_id", "detector_id").agg(F.count("*").alias("value"))


def sessions_active(changes: DataFrame) -> DataFrame:
    """Gauge by listener from (listener, delta)."""
    return changes.groupBy("listener").agg(F.sum("delta").alias("value"))


def sessions_total(changes: DataFrame) -> DataFrame:
    return changes.where("delta > 0").groupBy("listener").agg(F.sum("delta").alias("value"))


def capped(increments: DataFrame, labels: list[str], order: str, value: str, cap: int = MAX_SERIES) -> DataFrame:
    """(labels, value, is_overflow): the first ``cap`` label sets by first appearance; all later ones are one sum.

    Sets are counted by a partial aggregation; the first of them are a top-k, and what overflows is the total less
    what they have, so no task sees all sets.
    """
    sets = increments.groupBy(*labels).agg(F.min(order).alias("_first"), F.sum(value).cast("long").alias("value"))
    kept = sets.orderBy("_first", *labels).limit(cap).select(*labels, "value", F.lit(False).alias("is_overflow"))
    whole = increments.agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("_all"))
    own = kept.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("_kept"))
    kinds = dict(increments.dtypes)
    over = whole.crossJoin(own).select(*[F.lit(None).cast(kinds[c]).alias(c) for c in labels], (F.col("_all") - F.col("_kept")).alias("value"), F.lit(True).alias("is_overflow"))
    return kept.unionByName(over)


def rendered(series: DataFrame, labels: list[str], name: str, kind: str, help_text: str, cap: int = MAX_SERIES) -> DataFrame:
    """(line_no, line) of the text exposition of one metric from what ``capped`` returns."""
    pairs = [F.concat(F.lit(f'{c}="'), escape_label_value(F.col(c).cast("string")), F.lit('"')) for c in sorted(labels)]
    line = F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} "), F.col("value").cast("string"))
    over = name[: -len("_total")] + "_overflow_total" if name.endswith("_total") else name + "_overflow"
    own = series.where("NOT is_overflow").select(line.alias("line"))
    sums = series.agg(F.collect_list(F.when(~F.col("is_overflow"), 1)).alias("n"), F.coalesce(F.sum(F.when(F.col("is_overflow"), F.col("value"))), F.lit(0)).alias("over"))
    what = "Label sets dropped" if kind == "counter" else "Net change of label sets dropped"
    fixed = sums.select(F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.lit(f"# HELP {name} {help_text}").alias("line")),
        F.struct(F.lit(1).alias("part"), F.lit(f"# TYPE {name} {kind}").alias("line")),
        F.struct(F.lit(2).alias("part"), F.when((F.size("n") == 0) & (F.col("over") == 0), f"{name} 0").alias("line")),
        F.struct(F.lit(4).alias("part"), F.lit(f"# HELP {over} {what} beyond {cap} series of {name}.").alias("line")),
        F.struct(F.lit(5).alias("part"), F.lit(f"# TYPE {over} {kind}").alias("line")),
        F.struct(F.lit(6).alias("part"), F.concat(F.lit(over + " "), F.col("over").cast("string")).alias("line")),
    )).alias("x")).select("x.part", "x.line").where("line IS NOT NULL")
    lines = fixed.unionByName(own.select(F.lit(3).alias("part"), "line"))
    return lines.select(F.row_number().over(Window.orderBy("part", "line")).cast("long").alias("line_no"), "line")
