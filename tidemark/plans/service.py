"""The node's whole computation in batch: gate, crossings, log, counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.crossings import DEFAULT_WINDOW_NS, crossings, log_rows
from ..operators.gate import accepted, gate_decisions
from ..operators.log import with_offsets


@dataclass
class Ingested:
    decided: DataFrame
    accepted: DataFrame
    crossings: DataFrame
    log: DataFrame


def ingest(detections: DataFrame, window_ns: int = DEFAULT_WINDOW_NS, seed: DataFrame | None = None, base_offset: int = 0, emit_open: bool = False) -> Ingested:
    """Lazy plans of every step; a restart passes the high-water marks and the next offset."""
    decided = gate_decisions(detections, seed)
    good = accepted(decided)
    log = with_offsets(log_rows(good, window_ns), base_offset).drop("tie")
    return Ingested(decided, good, crossings(good, window_ns, emit_open), log)
