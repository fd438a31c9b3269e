"""From envelopes on the wire to detections: sessions, dispatch, payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.codec import BadData, decode_detection, encode_detection
from ..schema import MAX_PRODUCER_ID_BYTES, detection
from .validate import dispatched, until_end


def with_detections(envelopes: DataFrame) -> DataFrame:
    """Adds ``payload_ok`` and ``body``, the detection that the payload of an Event envelope holds."""
    body = detection()

    @F.arrow_udf(body)
    def decoded(payloads: pa.Array) -> pa.Array:
        out = []
        for data in payloads.to_pylist():
            try:
                out.append(None if data is None else decode_detection(data))
            except BadData:
                out.append(None)
        return pa.array(out, pa.struct(list(to_arrow_schema(body))))

    read = envelopes.withColumn("body", F.when(F.col("message_type") == "Event", decoded("payload")))
    return read.withColumn("payload_ok", (F.col("message_type") != "Event") | F.col("body.detection_id").isNotNull())


def with_payloads(detections: DataFrame) -> DataFrame:
    """The reverse: adds ``payload``, the Event payload of the row's detection."""
    names = detection().names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode_detection(r) for r in batch.select(names).to_pylist()]
            yield batch.append_column("payload", pa.array(made, pa.binary()))

    return detections.mapInArrow(run, T.StructType([*detections.schema.fields, T.StructField("payload", T.BinaryType())]))


def received(envelopes: DataFrame) -> DataFrame:
    """Detections, with producer_id and arrival, of the Event envelopes (session, arrival, registered_id, envelope fields)
    that each session surfaces before it ends, by an error or a disconnect."""
    read = with_detections(envelopes.withColumn("has_payload", F.col("payload").isNotNull()))
    kept = until_end(dispatched(read)).where("action = 'Event'")
    width = F.octet_length("registered_id")
    return kept.where((width >= 1) & (width <= MAX_PRODUCER_ID_BYTES)).select(F.col("registered_id").alias("producer_id"), "arrival", "body.*")
