"""The event log: dense offsets from 0, range reads, bounds, segments, retention, resume.

Offsets are given without a global sort: entries are counted by stretches of the order key, a small running sum gives
each stretch its base, and rows are numbered within stretches in parallel.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import MAX_PRODUCER_ID_BYTES

STRETCH = 1 << 20
SEGMENT_BYTES, SEGMENT_AGE_NS = 64 << 20, 3600 * 10**9
#: Rows of an append that one task sorts and numbers.
SORTED_ROWS = 1 << 18
DEFAULT_PAGE, MAX_PAGE = 100, 1000


class StorageError(Exception):
    pass


class InvalidInput(StorageError):
    pass


class Corrupted(StorageError):
    pass


class RetentionExpired(StorageError):
    """The offset asked for is gone; ``earliest`` is the first that is left, None if there is none."""

    def __init__(self, requested: int, earliest: int | None):
        super().__init__(f"offset {requested} is no longer kept; earliest is {earliest}")
        self.requested, self.earliest = requested, earliest


#: What a web front end answers.
STATUS_OF = {RetentionExpired: 410, KeyError: 404, StorageError: 503}


def status_of(error: Exception) -> int:
    return next((s for kind, s in STATUS_OF.items() if isinstance(error, kind)), 503)


def with_offsets(entries: DataFrame, base: int = 0, stretch: int = STRETCH) -> DataFrame:
    """Adds ``offset`` by (trigger_arrival, is_derived, tie): an event, then the crossings it closed."""
    rows = entries.withColumn("_part", F.expr(f"trigger_arrival div {stretch}"))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_part").alias("_b"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_part").orderBy("trigger_arrival", "is_derived", "tie")
    numbered = rows.withColumn("_k", F.row_number().over(w)).join(before, F.col("_part") == F.col("_b"))
    return numbered.select((F.col("_before") + F.col("_k") - 1 + base).cast("long").alias("offset"), *entries.columns)


def log_entries(events: DataFrame, crossings: DataFrame, base: int = 0, stretch: int = STRETCH) -> DataFrame:
    """Accepted events interleaved with the crossings that they closed: (offset, trigger_arrival, is_derived, producer_id,
    kind, detection_id, crossing_id, timing_point_id, subject_id, at_ns)."""
    e = events.select(
        F.col("arrival").alias("trigger_arrival"), F.lit(False).alias("is_derived"), F.col("detection_id").alias("tie"), "producer_id", F.lit("Detection").alias("kind"),
        "detection_id", F.lit(None).cast("string").alias("crossing_id"), "timing_point_id", "subject_id", F.col("detected_at_ns").alias("at_ns"),
    )
    c = crossings.select(
        "trigger_arrival", F.lit(True).alias("is_derived"), F.col("crossing_id").alias("tie"), F.col("trigger_producer_id").alias("producer_id"), F.lit("Crossing").alias("kind"),
        F.lit(None).cast("string").alias("detection_id"), "crossing_id", "timing_point_id", "subject_id", F.col("crossed_at_ns").alias("at_ns"),
    )
    return with_offsets(e.unionByName(c), base, stretch).drop("tie")


def read_range(log: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """[start, end) by offset: a filter that reaches the scan, never a limit."""
    kept = log.where(F.col("offset") >= start)
    if end is not None:
        kept = kept.where(F.col("offset") < end)
    return kept.orderBy("offset")


def bounds(log: DataFrame) -> DataFrame:
    return log.agg(F.min("offset").alias("earliest_offset"), F.max("offset").alias("latest_offset"))


def page_range(start: int | None = None, limit: int | None = None) -> tuple[int, int]:
    """[from, from + limit) with the defaults and the clamp of a page; saturating."""
    start = 0 if start is None else start
    limit = min(DEFAULT_PAGE if limit is None else limit, MAX_PAGE)
    return start, min(start + limit, 2**63 - 1)


def page(log: DataFrame, start: int | None = None, limit: int | None = None) -> DataFrame:
    """A page of entries without producer and append time."""
    hidden = {"producer_id", "appended_at_ns"}
    out = read_range(log, *page_range(start, limit))
    return out.select(*[c for c in out.columns if c not in hidden])


def retained(manifest: DataFrame, now_ns: int | None = None, max_age_ns: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Adds ``keep``: time, then size, oldest first; the active segment always stays.

    By time a closed segment goes if its last append is before now - age, and everything older is gone; by size closed
    segments go from the oldest while those left and the active one have more than the bytes allowed.
    """
    w = Window.orderBy("base_offset")
    keep = F.lit(True)
    if max_age_ns is not None:
        young = ~F.col("closed") | (F.col("last_appended_at_ns") >= now_ns - max_age_ns)
        keep = F.max(young.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    rows = manifest.withColumn("_timely", keep)
    if max_bytes is not None:
        left = F.sum(F.when(F.col("_timely"), F.col("byte_size")).otherwise(0)).over(Window.orderBy(F.desc("base_offset")).rowsBetween(Window.unboundedPreceding, 0))
        keep = F.col("_timely") & (~F.col("closed") | (left <= max_bytes))
    else:
        keep = F.col("_timely")
    return rows.withColumn("keep", keep).drop("_timely")


def rolled(sizes: Iterator[tuple[int, int, int]], max_bytes: int = SEGMENT_BYTES, max_age_ns: int = SEGMENT_AGE_NS) -> Iterator[tuple[int, int]]:
    """(offset, segment base) of appends (offset, bytes, appended_at_ns): a segment ends after the append that fills it
    or finds it too old."""
    base, held, created = None, 0, 0
    for offset, size, at in sizes:
        if base is None:
            base, held, created = offset, 0, at
        held += size
        yield offset, base
        if held >= max_bytes or at - created >= max_age_ns:
            base = None


@dataclass
class Segment:
    base_offset: int
    last_offset: int
    created_at_ns: int
    last_appended_at_ns: int
    byte_size: int
    closed: bool


class EventLog:
    """A log in a folder: ``data/segment_base=N/append=M`` in Parquet, and ``manifest.json``, replaced by a rename.

    One writer. An append is one batch of rows with offsets from the manifest's next; a batch id that was appended
    before is not appended again, so a replayed micro-batch changes nothing. Files that the manifest doesn't name, as
    of an append that died, are never read.
    """

    def __init__(self, spark: SparkSession, path: str, max_bytes: int = SEGMENT_BYTES, max_age_ns: int = SEGMENT_AGE_NS, retain_age_ns: int | None = None, retain_bytes: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.max_bytes, self.max_age_ns, self.retain_age_ns, self.retain_bytes = max_bytes, max_age_ns, retain_age_ns, retain_bytes
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self) -> dict:
        where = self._path(f"{self.path}/manifest.json")
        if not self._fs.exists(where):
            return {"next_offset": 0, "segments": [], "appends": [], "last_batch": -1}
        stream = self._fs.open(where)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError as e:
            raise Corrupted(f"manifest of {self.path}: {e}") from None

    def _write(self, manifest: dict) -> None:
        new = self._path(f"{self.path}/manifest-{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        # Readers see the old manifest or the new one, never none.
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        replace = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        replace[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        where = self._fs.makeQualified(self._path(f"{self.path}/manifest.json"))
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(new), where, replace)

    def append(self, rows: DataFrame, order: list[str | Column], appended_at_ns: int, batch_id: int | None = None) -> int | None:
        """Appends all rows in the given total order; returns the last offset, None if the batch was there already."""
        manifest = self._read()
        if batch_id is not None and batch_id <= manifest["last_batch"]:
            return None
        if "producer_id" not in rows.columns:
            raise InvalidInput("rows need producer_id")
        base = manifest["next_offset"]
        segments = manifest["segments"]
        current = segments[-1] if segments and not segments[-1]["closed"] else None
        segment_base = current["base_offset"] if current else base
        where = f"{self.path}/data/segment_base={segment_base}/append={uuid.uuid4().hex}"
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        try:
            # Made once: what follows reads it more than once, and a micro-batch's rows come out of state.
            rows.write.parquet(f"{staged}/rows")
            made = self.spark.read.parquet(f"{staged}/rows")
            width = F.octet_length(F.coalesce("producer_id", F.lit("")))
            n, bad = made.agg(F.count("*"), F.coalesce(F.sum(((width < 1) | (width > MAX_PRODUCER_ID_BYTES)).cast("long")), F.lit(0))).first()
            if bad:
                raise InvalidInput("a producer id has 1 to 256 bytes")
            if not n:
                if batch_id is None:
                    raise InvalidInput("nothing to append")
                manifest["last_batch"] = batch_id
                self._write(manifest)
                return base - 1 if base else None
            placed = self._placed(made, order, n, f"{staged}/sorted")
            placed.select((F.col("_k") + base).cast("long").alias("offset"), F.lit(appended_at_ns).cast("long").alias("appended_at_ns"), *rows.columns).write.parquet(where)
        finally:
            self._fs.delete(self._path(staged), True)
        size = int(self._fs.getContentSummary(self._path(where)).getLength())
        if current is None:
            current = asdict(Segment(base, base, appended_at_ns, appended_at_ns, 0, False))
            segments.append(current)
        current["last_offset"], current["last_appended_at_ns"] = base + n - 1, appended_at_ns
        current["byte_size"] += size
        manifest["appends"].append({"segment_base": current["base_offset"], "path": where, "first": base, "last": base + n - 1})
        manifest["next_offset"] = base + n
        if batch_id is not None:
            manifest["last_batch"] = batch_id
        gone: list[int] = []
        if current["byte_size"] >= self.max_bytes or appended_at_ns - current["created_at_ns"] >= self.max_age_ns:
            current["closed"] = True
            gone = self._expired(segments, appended_at_ns)
        manifest["segments"] = [s for s in segments if s["base_offset"] not in gone]
        manifest["appends"] = [a for a in manifest["appends"] if a["segment_base"] not in gone]
        self._write(manifest)
        for base_offset in gone:
            self._fs.delete(self._path(f"{self.path}/data/segment_base={base_offset}"), True)
        return base + n - 1

    def _placed(self, rows: DataFrame, order: list[str | Column], n: int, folder: str) -> DataFrame:
        """Adds ``_k``, a row's place from 0 in the given order, without a task that sees all rows: ranges of the order are
        sorted each by a task and written, then counted, and the counts before a range make its base."""
        parts = -(-n // SORTED_ROWS)
        ranges = rows.coalesce(1) if parts == 1 else rows.repartitionByRange(parts, *order)
        numbered = ranges.sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("_k"), *rows.columns)
        if parts == 1:
            return numbered
        numbered.write.parquet(folder)
        # The id has the range above its 33 lower bits, and the place within the range in them.
        read = self.spark.read.parquet(folder).withColumn("_range", F.shiftright("_k", 33))
        before, bases = 0, []
        for r in sorted(read.groupBy("_range").count().collect()):
            bases.append((r["_range"], before - (r["_range"] << 33)))
            before += r["count"]
        base = self.spark.createDataFrame(bases, "_range bigint, _base bigint")
        return read.join(F.broadcast(base), "_range").withColumn("_k", F.col("_k") + F.col("_base"))

    def _expired(self, segments: list[dict], now_ns: int) -> list[int]:
        """Closed segments that retention removes, oldest first; asked only after a roll."""
        left = list(segments)
        gone = []
        if self.retain_age_ns is not None:
            while left and left[0]["closed"] and left[0]["last_appended_at_ns"] < now_ns - self.retain_age_ns:
                gone.append(left.pop(0)["base_offset"])
        if self.retain_bytes is not None:
            while left and left[0]["closed"] and sum(s["byte_size"] for s in left) > self.retain_bytes:
                gone.append(left.pop(0)["base_offset"])
        return gone

    def earliest_offset(self) -> int | None:
        return self._earliest(self._read())

    @staticmethod
    def _earliest(manifest: dict) -> int | None:
        segments = manifest["segments"]
        return max(segments[0]["base_offset"], manifest.get("floor", 0)) if segments else None

    def evict_below(self, offset: int) -> None:
        """Makes everything before an offset unreadable, the next offset at most; segments that are gone whole are deleted."""
        manifest = self._read()
        floor = manifest["floor"] = max(manifest.get("floor", 0), min(offset, manifest["next_offset"]))
        gone = [s["base_offset"] for s in manifest["segments"] if s["last_offset"] < floor]
        manifest["segments"] = [s for s in manifest["segments"] if s["base_offset"] not in gone]
        manifest["appends"] = [a for a in manifest["appends"] if a["segment_base"] not in gone]
        self._write(manifest)
        for base_offset in gone:
            self._fs.delete(self._path(f"{self.path}/data/segment_base={base_offset}"), True)

    def evict_all(self) -> None:
        self.evict_below(self.next_offset())

    def latest_offset(self) -> int | None:
        segments = self._read()["segments"]
        return segments[-1]["last_offset"] if segments else None

    def next_offset(self) -> int:
        return self._read()["next_offset"]

    def segments(self) -> DataFrame:
        rows = [tuple(s[k] for k in ("base_offset", "last_offset", "last_appended_at_ns", "byte_size", "closed")) for s in self._read()["segments"]]
        return self.spark.createDataFrame(rows, "base_offset bigint, last_offset bigint, last_appended_at_ns bigint, byte_size bigint, closed boolean")

    def read_range(self, start: int, end: int | None = None) -> DataFrame | None:
        """[start, end) ascending; None is an empty answer. Expired offsets are an error, checked before emptiness."""
        return self._range(self._read(), start, end)[0]

    def _range(self, manifest: dict, start: int, end: int | None = None) -> tuple[DataFrame | None, int]:
        """The rows and where they stop, by one manifest: what is appended meanwhile is in neither."""
        earliest = self._earliest(manifest)
        if start < manifest["next_offset"] and (earliest is None or start < earliest):
            raise RetentionExpired(start, earliest)
        stop = manifest["next_offset"] if end is None else min(end, manifest["next_offset"])
        if start >= stop:
            return None, start
        paths = [a["path"] for a in manifest["appends"] if a["last"] >= start and a["first"] < stop]
        return read_range(self.spark.read.parquet(*paths), start, stop), stop

    def read_page(self, start: int | None = None, limit: int | None = None) -> tuple[DataFrame | None, int | None]:
        """A page and the latest offset."""
        rows = self.read_range(*page_range(start, limit))
        if rows is not None:
            rows = rows.select(*[c for c in rows.columns if c not in ("producer_id", "appended_at_ns")])
        return rows, self.latest_offset()

    def tail(self, start: int) -> Iterator[DataFrame]:
        """What is there from ``start``, then, on each next(), what was appended since (an empty answer waits: it is
        skipped by the caller). An offset that was evicted meanwhile ends the tail by RetentionExpired."""
        at = start
        while True:
            rows, at = self._range(self._read(), at)
            yield self.spark.createDataFrame([], "offset bigint") if rows is None else rows
