"""Python data sources: recorded wire frames as envelopes, log segments as entries.

``spark.dataSource.register(FrameSource)`` and ``spark.read.format("frames").option("framing", "stream").load(path)``.
One file is one task's work, read in pieces. Paths are of any file system that pyarrow opens, which on a cluster must
be one that all executors share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.codec import ENVELOPE_FIELDS, SerialDecoder, StreamDecoder, segment_header, segment_record, segment_stream, serial_frame, stream_frame

CHUNK = 1 << 20
_ENVELOPE = "protocol_version smallint, message_type string, source_id string, stream_id string, sequence_number bigint, correlation_id string, payload binary, traceparent string"
_ENTRY = "offset bigint, appended_at_ns bigint, producer_id string, event binary"


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[str]:
    from pyarrow import fs

    where, root = opened(path)
    if where.get_file_info(root).type == fs.FileType.File:
        return [root]
    own = [f.path for f in where.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    return sorted(f for f in own if not any(part.startswith(("_", ".")) for part in f.removeprefix(root).split("/")))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        self.framing = options.get("framing", "stream")
        self.most = int(options.get("maxFrameBytes", 65535))

    def partitions(self):
        return [InputPartition(f) for f in _files(self.path)]

    def pieces(self, partition: InputPartition) -> Iterator[bytes]:
        where, _ = opened(self.path)
        with where.open_input_stream(partition.value) as f:
            while data := f.read(CHUNK):
                yield data


class _FrameReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        decoder = StreamDecoder(self.most) if self.framing == "stream" else SerialDecoder(self.most)
        name, k = partition.value.rsplit("/", 1)[-1], 0

        def row(envelope: dict | None, error: str | None) -> tuple:
            return (name, k, *(None if envelope is None else envelope[f] for f in ENVELOPE_FIELDS), error)

        for data in self.pieces(partition):
            for envelope, error in decoder.push(data):
                yield row(envelope, error)
                k += 1
        if decoder.has_pending:
            yield row(None, "Truncated")


@dataclass
class _Written(WriterCommitMessage):
    new: str
    done: str


class _Writer(DataSourceArrowWriter):
    """Tasks write files that readers skip; they get their names when all tasks are done."""

    def __init__(self, options, overwrite: bool):
        self.path, self.framing, self.overwrite = options.get("path").rstrip("/"), options.get("framing", "stream"), overwrite

    def encoded(self, rows) -> Iterator[bytes]:
        frame = stream_frame if self.framing == "stream" else serial_frame
        return (frame(r) for r in rows)

    def write(self, batches) -> WriterCommitMessage:
        from pyspark import TaskContext

        part = f"{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}"
        where, root = opened(self.path)
        where.create_dir(root, recursive=True)
        new = f"{root}/_part-{part}"
        with where.open_output_stream(new) as f:
            for data in self.encoded(r for b in batches for r in b.to_pylist()):
                f.write(data)
        return _Written(new, f"{root}/part-{part}.bin")

    def commit(self, messages) -> None:
        where, _ = opened(self.path)
        if self.overwrite:
            for old in _files(self.path):
                where.delete_file(old)
        for m in messages:
            if m is not None:
                where.move(m.new, m.done)

    def abort(self, messages) -> None:
        where, _ = opened(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(m.new)


class FrameSource(DataSource):
    """Frames of recorded sessions: (file, frame, envelope fields, error). A bad frame is a row with its error; bytes
    that are left at the end of a file are ``Truncated``."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return f"file string, frame bigint, {_ENVELOPE}, error string"

    def reader(self, schema):
        return _FrameReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


class _SegmentReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from segment_stream(self.pieces(partition))


class _SegmentWriter(_Writer):
    def encoded(self, rows) -> Iterator[bytes]:
        first = True
        for r in rows:
            if first:
                yield segment_header(r["offset"], r["appended_at_ns"])
                first = False
            yield segment_record(r["offset"], r["appended_at_ns"], r["producer_id"], bytes(r["event"]))


class SegmentSource(DataSource):
    """Segment files of a native log: (offset, appended_at_ns, producer_id, event), up to the first record that isn't whole.

    Written, each task's rows are a segment: dense offsets in order.
    """

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return _ENTRY

    def reader(self, schema):
        return _SegmentReader(self.options)

    def writer(self, schema, overwrite):
        return _SegmentWriter(self.options, overwrite)
