"""The same computation as a stream: gate state by producer and detector, open groups by point and subject, log append.

Rows of a key may come in several pieces within a micro-batch, so each call gathers and sorts them by arrival, and works
on columns: points and subjects are many and have few rows each, so a call has a shard of them. State
has no time-out; checkpoints hold it, and an append's batch id makes a replayed micro-batch harmless.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.crossings import _COLUMNS, DEFAULT_WINDOW_NS, crossing_id, grouped
from ..operators.log import EventLog
from ..schema import flat

_IN = "producer_id string, detector_id string, timing_point_id string, subject_id string, detection_id string, arrival bigint, sequence_number bigint, detected_at_ns bigint, detected_at_uncertainty_ns bigint, rssi int, timebase_id string, timestamping_method string, source_attestation string"
_ROW = flat(_IN)
_ARROW = {"arrival": pa.int64(), "sequence_number": pa.int64(), "detected_at_ns": pa.int64(), "detected_at_uncertainty_ns": pa.int64(), "rssi": pa.int32()} | {f.name: pa.string() for f in _ROW if f.dataType == T.StringType()}
#: What state has of an open group's rows.
_HELD = ("detection_id", "arrival", "detected_at_ns", "detected_at_uncertainty_ns", "rssi", "timebase_id", "timestamping_method", "source_attestation")
#: Keys of state come in so many parts, each one call a micro-batch; a checkpoint is bound to it.
SHARDS = 512
_PIECE = 10_000
_OUT = flat(
    "trigger_arrival bigint, is_derived boolean, producer_id string, kind string, detection_id string, timing_point_id string, subject_id string, at_ns bigint, "
    "uncertainty_ns bigint, timebase_id string, timestamping_method string, source_attestation string, detection_ids array<string>"
)


def _gathered(rows, names: list[str]) -> pa.Table | None:
    """All rows of a key in a micro-batch."""
    tables = [pa.Table.from_arrays([pa.array(f[c], _ARROW[c], from_pandas=True) for c in names], names=names) for f in rows if len(f)]
    return pa.concat_tables(tables).combine_chunks() if tables else None


def _frame(table: pa.Table) -> pd.DataFrame:
    return table.to_pandas(integer_object_nulls=True)


class Gate(StatefulProcessor):
    """Keeps what is above the running maximum of the rows before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.high = handle.getValueState("high_water", "high_water bigint")

    def handleInputRows(self, key, rows, timerValues):
        table = _gathered(rows, _ROW.names)
        if table is None:
            return
        table = table.sort_by("arrival")
        n = table.column("sequence_number").to_numpy()
        known = self.high.exists()
        high = int(self.high.get()[0]) if known else int(n[0])
        top = np.maximum.accumulate(np.concatenate(([high], n)))
        keep = n > top[:-1]
        if not known:
            keep[0] = True
        if keep.any():
            self.high.update((int(top[-1]),))
            kept = table.filter(pa.array(keep))
            for at in range(0, kept.num_rows, _PIECE):
                yield _frame(kept.slice(at, _PIECE))

    def close(self) -> None:
        pass


class Crossings(StatefulProcessor):
    """Passes every detection on, each followed by the crossings that it closes.

    A call has the rows of a shard of the keys, and groups them all as the batch operator does; state has each key's
    open group, of which only those that the rows touch are read and written.
    """

    def __init__(self, window_ns: int):
        self.window_ns = window_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "key string", "rows string")

    def _before(self, fresh: pa.Table) -> pa.Table | None:
        """Rows of the open groups of the keys that have a row."""
        keys = fresh.filter(pc.is_valid(fresh.column("subject_id"))).group_by(["timing_point_id", "subject_id"]).aggregate([])
        held = []
        for point, subject in zip(keys.column("timing_point_id").to_pylist(), keys.column("subject_id").to_pylist()):
            found = self.open.getValue((json.dumps([point, subject]),))
            if found is not None:
                columns = dict(zip(_HELD, json.loads(found[0])))
                m = len(columns["arrival"])
                columns |= {"timing_point_id": [point] * m, "subject_id": [subject] * m, "producer_id": [None] * m}
                held.append([columns[c] for c in _COLUMNS])
        if not held:
            return None
        return pa.Table.from_arrays([pa.array([x for h in held for x in h[k]], fresh.schema.field(c).type) for k, c in enumerate(_COLUMNS)], names=_COLUMNS)

    def handleInputRows(self, key, rows, timerValues):
        fresh = _gathered(rows, _COLUMNS)
        if fresh is None:
            return
        before = self._before(fresh)
        both = fresh if before is None else pa.concat_tables([before, fresh])
        is_new = np.arange(both.num_rows) >= both.num_rows - fresh.num_rows
        code = lambda c: both.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((both.column("arrival").to_numpy(), is_new, code("subject_id"), code("timing_point_id")))
        sorted_rows, is_new = both.take(pa.array(order)).combine_chunks().to_batches()[0], is_new[order]
        groups = pa.Table.from_batches([g for _, g in grouped(iter([sorted_rows]), self.window_ns)]).combine_chunks()
        ends = np.cumsum(pc.list_value_length(groups.column("detection_ids")).to_numpy())
        starts = np.concatenate(([0], ends[:-1]))
        # A key's last group is open; it is written if it has a new row.
        touched = np.add.reduceat(is_new.astype(np.int64), starts) > 0
        for k in np.flatnonzero(groups.column("is_open").to_numpy() & touched).tolist():
            own = sorted_rows.slice(int(starts[k]), int(ends[k] - starts[k]))
            name = json.dumps([own.column("timing_point_id")[0].as_py(), own.column("subject_id")[0].as_py()])
            self.open.updateValue((name,), (json.dumps([own.column(c).to_pylist() for c in _HELD]),))
        n = fresh.num_rows
        same = ("timing_point_id", "subject_id", "timebase_id", "timestamping_method", "source_attestation")
        passed = {c: fresh.column(c) for c in (*same, "detection_id", "producer_id")} | {
            "trigger_arrival": fresh.column("arrival"), "is_derived": pa.repeat(False, n), "kind": pa.repeat("Detection", n), "at_ns": fresh.column("detected_at_ns"), "uncertainty_ns": fresh.column("detected_at_uncertainty_ns"),
            "detection_ids": pa.nulls(n, pa.list_(pa.string())),
        }
        done = groups.filter(pc.invert(groups.column("is_open")))
        m = done.num_rows
        made = {c: done.column(c) for c in (*same, "trigger_arrival", "detection_ids")} | {
            "producer_id": done.column("trigger_producer_id"), "is_derived": pa.repeat(True, m), "kind": pa.repeat("Crossing", m), "at_ns": done.column("crossed_at_ns"), "uncertainty_ns": done.column("crossed_at_uncertainty_ns"),
            "detection_id": pa.nulls(m, pa.string()),
        }
        for out in (passed, made):
            table = pa.table({c: out[c] for c in _OUT.names})
            for at in range(0, table.num_rows, _PIECE):
                yield _frame(table.slice(at, _PIECE))

    def close(self) -> None:
        pass


def log_stream(detections: DataFrame, window_ns: int = DEFAULT_WINDOW_NS) -> DataFrame:
    """Log rows of a stream of detections: gate, grouping, and the crossings after the events that close them."""
    rows = detections.select(
        "producer_id", "detector_id", "timing_point_id", "subject_id", "detection_id", "arrival", "sequence_number", "detected_at_ns", "detected_at_uncertainty_ns",
        F.when(F.col("sensor.kind") == "LoopTransponder", F.col("sensor.rssi_dbm")).cast("int").alias("rssi"), "timebase_id", "timestamping_method", "source_attestation",
    )
    kept = rows.groupBy("producer_id", "detector_id").transformWithStateInPandas(Gate(), _ROW, "Append", "None")
    # Rows without subject are spread; nothing is held for them.
    shard = F.pmod(F.xxhash64("timing_point_id", F.coalesce("subject_id", F.col("arrival").cast("string"))), F.lit(SHARDS))
    made = kept.withColumn("_shard", shard).groupBy("_shard").transformWithStateInPandas(Crossings(window_ns), _OUT, "Append", "None")
    return made.withColumn("crossing_id", F.when(F.col("is_derived"), crossing_id(F.col("timing_point_id"), F.col("subject_id"), F.element_at("detection_ids", 1))))


def run_log(detections: DataFrame, log: EventLog, checkpoint: str, clock: Callable[[int], int], window_ns: int = DEFAULT_WINDOW_NS) -> StreamingQuery:
    """Starts the stream into a log; ``clock`` gives a batch's append time. Needs the RocksDB state store."""

    def append(batch: DataFrame, batch_id: int) -> None:
        log.append(batch, ["trigger_arrival", "is_derived", F.coalesce("detection_id", "crossing_id")], clock(batch_id), batch_id)

    return log_stream(detections, window_ns).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def subscribe(spark: SparkSession, log: str, schema: T.StructType, start: int) -> DataFrame:
    """Backfill and tail of the log in a folder from an offset, as a stream; an offset that was evicted, at the start or
    later, ends it with RetentionExpired, one that isn't there yet waits."""
    from ..sources.entries import EntrySource

    spark.dataSource.register(EntrySource)
    return spark.readStream.format("entries").schema(schema).option("startingOffset", start).load(log)
