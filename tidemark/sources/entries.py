"""A log's entries as a stream: backfill from an offset, then what is appended, without gaps.

``spark.dataSource.register(EntrySource)`` and ``spark.readStream.format("entries").schema(...).option("startingOffset",
n).load(folder of the log)``. Each micro-batch is planned from one manifest: only files that it names are read, and
offsets that retention has removed end the stream with RetentionExpired, at the start or later. The stream's checkpoint
holds the next offset.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.log import RetentionExpired
from .frames import _files, opened


@dataclass
class _Piece(InputPartition):
    path: str
    start: int
    stop: int


class _Entries(DataSourceStreamReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.start = options.get("path").rstrip("/"), int(options.get("startingOffset", 0))
        self.names = schema.names

    def manifest(self) -> dict:
        from pyarrow import fs

        where, root = opened(self.path)
        if where.get_file_info(f"{root}/manifest.json").type == fs.FileType.NotFound:
            return {"next_offset": 0, "segments": [], "appends": []}
        with where.open_input_stream(f"{root}/manifest.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"offset": self.start}

    def latestOffset(self) -> dict:
        return {"offset": max(self.start, self.manifest()["next_offset"])}

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        a, b = start["offset"], end["offset"]
        manifest = self.manifest()
        segments = manifest["segments"]
        earliest = max(segments[0]["base_offset"], manifest.get("floor", 0)) if segments else None
        if a < min(b, manifest["next_offset"]) and (earliest is None or a < earliest):
            raise RetentionExpired(a, earliest)
        appends = [x["path"] for x in manifest["appends"] if x["last"] >= a and x["first"] < b]
        # A file is a task's work, as an append may be large.
        return [_Piece(f, a, b) for append in appends for f in self.files(append)]

    def files(self, append: str) -> list[str]:
        """Paths as ``opened`` takes them."""
        root = opened(append)[1]
        return [append.removesuffix(root) + f for f in _files(append) if f.endswith(".parquet")]

    def read(self, partition: _Piece) -> Iterator:
        import pyarrow.dataset as ds

        where, root = opened(partition.path)
        of = ds.field("offset")
        rows = ds.dataset(root, filesystem=where, format="parquet").scanner(columns=self.names, filter=(of >= partition.start) & (of < partition.stop))
        yield from (b for b in rows.to_batches() if b.num_rows)

    def commit(self, end: dict) -> None:
        pass


class EntrySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "entries"

    def schema(self):
        raise ValueError("give the entries' schema")

    def streamReader(self, schema):
        return _Entries(self.options, schema)
