"""Crossings: detections of a subject at a timing point, grouped by a window that the first arrival of a group anchors.

A row joins the open group of its key if it isn't more than the window later than the anchor (earlier is fine); else
it closes the group and anchors the next. Rows go to their key's partition once, sorted by arrival; there one pass
over Arrow batches finds the anchors and reduces each group with numpy. Only the open group is held between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_WINDOW_NS = 2_000_000_000
_NO_RSSI = -32768
_COLUMNS = ("timing_point_id", "subject_id", "arrival", "producer_id", "detection_id", "detected_at_ns", "detected_at_uncertainty_ns", "timebase_id", "timestamping_method", "source_attestation", "rssi")
_OUT = (
    "timing_point_id string, subject_id string, crossed_at_ns bigint, crossed_at_uncertainty_ns bigint, timebase_id string, timestamping_method string, "
    "source_attestation string, detection_ids array<string>, first_arrival bigint, trigger_arrival bigint, trigger_producer_id string, is_open boolean"
)

_LOG = "trigger_arrival bigint, is_derived boolean, producer_id string, kind string, detection_id string, first_detection_id string, timing_point_id string, subject_id string, at_ns bigint"


def crossing_id(point: Column, subject: Column, first_detection: Column) -> Column:
    """The same id for the same group, however often it is computed."""
    return F.md5(F.concat_ws("\x1f", point, F.coalesce(subject, F.lit("")), first_detection))


def anchors(key: np.ndarray, times: np.ndarray, window: int, alone: np.ndarray) -> np.ndarray:
    """First rows of the groups; rows are sorted by key, then arrival. A row that is alone is a group of its own."""
    n = len(key)
    new = np.concatenate(([True], key[1:] != key[:-1]))
    # A key whose times all lie within the window of its first row needs no walk.
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    late = times - np.repeat(times[first], size) > window
    walk = np.unique(np.repeat(np.arange(len(first)), size)[late & ~alone])
    for k in walk.tolist():
        a, b = int(first[k]), int(first[k] + size[k])
        own = times[a:b]
        if b - a < 32:
            anchor = int(own[0])
            for i, t in enumerate(own.tolist()):
                if t - anchor > window:
                    new[a + i] = True
                    anchor = t
            continue
        # All rows before an anchor are earlier than it, so the next one is where the running maximum leaves its window.
        after = np.searchsorted(np.maximum.accumulate(own), own + window, side="right").tolist()
        i = after[0]
        while i < b - a:
            new[a + i] = True
            i = after[i]
    return np.flatnonzero(new | alone)


def _reduced(rows: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray, trigger: np.ndarray) -> pa.RecordBatch:
    """A row for each group; ``trigger`` has the row that closed it, -1 while it is open."""
    n = rows.num_rows
    group = np.repeat(np.arange(len(starts)), ends - starts)
    place = np.arange(n)
    times = rows.column("detected_at_ns").to_numpy(zero_copy_only=False)
    rssi = pc.fill_null(rows.column("rssi"), _NO_RSSI).to_numpy(zero_copy_only=False).astype(np.int64)
    by_rssi = np.lexsort((place, rssi, group))[ends - 1]
    by_time = np.lexsort((place, times, group))[starts]
    some = np.maximum.reduceat(rows.column("rssi").is_valid().to_numpy(zero_copy_only=False).astype(np.int8), starts) > 0
    peak = np.where(some, by_rssi, by_time)
    span = np.maximum.reduceat(times, starts) - np.minimum.reduceat(times, starts)
    at = pa.array(peak)
    own = rows.column("detected_at_uncertainty_ns").take(at)
    known = own.is_valid().to_numpy(zero_copy_only=False)
    value = np.maximum(pc.fill_null(own, 0).to_numpy(zero_copy_only=False), span)
    ids = rows.column("detection_id")
    head = pa.array(starts)
    closed = trigger >= 0
    pick = pa.array(np.where(closed, trigger, 0), mask=~closed)
    return pa.RecordBatch.from_arrays(
        [
            rows.column("timing_point_id").take(head), rows.column("subject_id").take(head), rows.column("detected_at_ns").take(at), pa.array(value, mask=~known & (span == 0)),
            rows.column("timebase_id").take(at), rows.column("timestamping_method").take(at), rows.column("source_attestation").take(at),
            pa.ListArray.from_arrays(pa.array(np.append(starts, n).astype(np.int32)), ids), rows.column("arrival").take(head),
            rows.column("arrival").take(pick), rows.column("producer_id").take(pick), pa.array(~closed),
        ],
        names=[c.split()[0] for c in _OUT.split(", ")],
    )


def grouped(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """(rows, their groups) of rows sorted by (timing_point_id, subject_id, arrival); each row comes once."""
    held: list[pa.RecordBatch] = []  # the open group, joined once, when a row has closed it
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and _goes_on(held[0], batch, window):
            held.append(batch)
            continue
        rows = _one([*held, batch])
        starts, key, alone = _starts(rows, window)
        if len(starts) > 1:  # the last group may go on in the next batch
            cut = int(starts[-1])
            yield rows.slice(0, cut), _closed(rows, starts[:-1], cut, key, alone)
            held = [rows.slice(cut)]
        else:
            held = [rows]
    if held:
        rows = _one(held)
        single = rows.column("subject_id")[0].as_py() is None
        yield rows, _reduced(rows, np.zeros(1, np.int64), np.array([rows.num_rows]), np.full(1, 0 if single else -1))


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def _goes_on(held: pa.RecordBatch, batch: pa.RecordBatch, window: int) -> bool:
    """Whether all rows of the batch belong to the group that began with the first row held."""
    n = batch.num_rows - 1
    for c in ("timing_point_id", "subject_id"):  # rows are sorted by both
        if batch.column(c)[0] != held.column(c)[0] or batch.column(c)[n] != held.column(c)[0] or held.column(c)[0].as_py() is None:
            return False
    return pc.max(batch.column("detected_at_ns")).as_py() - held.column("detected_at_ns")[0].as_py() <= window


def _starts(rows: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = lambda c: rows.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    subject = code("subject_id")
    key = code("timing_point_id") * (rows.num_rows + 2) + subject
    alone = subject < 0
    return anchors(key, rows.column("detected_at_ns").to_numpy(zero_copy_only=False), window, alone), key, alone


def _closed(rows: pa.RecordBatch, starts: np.ndarray, cut: int, key: np.ndarray, alone: np.ndarray) -> pa.RecordBatch:
    ends = np.append(starts[1:], cut)
    trigger = np.where(alone[starts], starts, np.where(key[ends] == key[starts], ends, -1))
    made = _reduced(rows.slice(0, cut), starts, ends, np.where(trigger < cut, trigger, -1))
    beyond = np.flatnonzero(trigger == cut)  # closed by the first row of the held group
    if not len(beyond):
        return made
    k = int(beyond[0])
    out = []
    for name, column in zip(made.schema.names, made.columns):
        if name in ("trigger_arrival", "trigger_producer_id", "is_open"):
            values = column.to_pylist()
            values[k] = False if name == "is_open" else rows.column("arrival" if name == "trigger_arrival" else "producer_id")[cut].as_py()
            column = pa.array(values, column.type)
        out.append(column)
    return pa.RecordBatch.from_arrays(out, names=made.schema.names)


def _log_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _LOG.split(", ")]
    for rows, groups in grouped(batches, window):
        n = rows.num_rows
        yield pa.RecordBatch.from_arrays(
            [rows.column("arrival"), pa.array(np.zeros(n, bool)), rows.column("producer_id"), pa.repeat("Detection", n), rows.column("detection_id"), pa.nulls(n, pa.string()), rows.column("timing_point_id"), rows.column("subject_id"), rows.column("detected_at_ns")], names=names
        )
        done = groups.filter(pc.invert(groups.column("is_open")))
        m = done.num_rows
        yield pa.RecordBatch.from_arrays(
            [done.column("trigger_arrival"), pa.array(np.ones(m, bool)), done.column("trigger_producer_id"), pa.repeat("Crossing", m), pa.nulls(m, pa.string()), pc.list_element(done.column("detection_ids"), 0) if m else pa.nulls(0, pa.string()), done.column("timing_point_id"), done.column("subject_id"), done.column("crossed_at_ns")], names=names
        )


def anonymous_crossings(detections: DataFrame) -> DataFrame:
    """A detection without subject is a crossing of its own at once; it has no state and no group."""
    d = detections.where("subject_id IS NULL")
    return d.select(
        "timing_point_id", "subject_id", F.col("detected_at_ns").alias("crossed_at_ns"), F.col("detected_at_uncertainty_ns").alias("crossed_at_uncertainty_ns"), "timebase_id", "timestamping_method",
        "source_attestation", F.array("detection_id").alias("detection_ids"), F.col("arrival").alias("first_arrival"), F.col("arrival").alias("trigger_arrival"), F.col("producer_id").alias("trigger_producer_id"), F.lit(False).alias("is_open"),
    )


def _sorted(detections: DataFrame) -> DataFrame:
    """Rows of a key together and in order of arrival; rows without subject are spread, as none waits for another."""
    loop = F.when(F.col("sensor.kind") == "LoopTransponder", F.col("sensor.rssi_dbm")).cast("int")
    rows = detections.withColumn("rssi", loop).select(*_COLUMNS)
    spread = F.coalesce("subject_id", F.concat(F.lit("\x00"), F.col("arrival").cast("string")))
    return rows.repartition("timing_point_id", spread).sortWithinPartitions("timing_point_id", "subject_id", "arrival")


def crossings(detections: DataFrame, window_ns: int = DEFAULT_WINDOW_NS, emit_open: bool = False) -> DataFrame:
    """All crossings of gate survivors, named and anonymous, in one pass. Without ``emit_open`` a key's last group, which
    nothing has closed, is left out, as a running node never flushes."""
    made = _sorted(detections).mapInArrow(lambda batches: (groups for _, groups in grouped(batches, window_ns)), _OUT)
    if not emit_open:
        made = made.where("NOT is_open")
    ident = crossing_id(F.col("timing_point_id"), F.col("subject_id"), F.element_at("detection_ids", 1))
    return made.select(ident.alias("crossing_id"), *made.columns)


def log_rows(detections: DataFrame, window_ns: int = DEFAULT_WINDOW_NS) -> DataFrame:
    """Gate survivors and the crossings that they close, in one pass: what the log gets, but for offsets."""
    made = _sorted(detections).mapInArrow(lambda batches: _log_rows(batches, window_ns), _LOG)
    ident = F.when(F.col("is_derived"), crossing_id(F.col("timing_point_id"), F.col("subject_id"), F.col("first_detection_id")))
    return made.withColumn("crossing_id", ident).select("trigger_arrival", "is_derived", F.coalesce("detection_id", "crossing_id").alias("tie"), "producer_id", "kind", "detection_id", "crossing_id", "timing_point_id", "subject_id", "at_ns")
