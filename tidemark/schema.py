"""Schemas and closed domains of the event model. Times are nanoseconds in BIGINT, never TIMESTAMP."""

from __future__ import annotations

from pyspark.sql import types as T

TIMESTAMPING_METHODS = ("HardwareEventCapture", "FirmwareTimerRead", "AdapterReceiveTime", "ManualEntry", "ReplayRecorded")
SOURCE_ATTESTATIONS = ("RuntimeDiscovered", "OperatorAsserted")
SYNC_STATES = ("Locked", "Holdover", "FreeRun", "Unsynchronized", "Unknown")
STREAM_KINDS = ("Raw", "Detections", "Processed")
SENSOR_KINDS = ("LoopTransponder", "BeamBreak", "Manual")
HEALTH_STATES = ("Healthy", "Degraded", "Failed")
MESSAGE_TYPES = ("Event", "Connect", "ConnectAck", "ConnectReject", "Heartbeat", "Error", "Disconnect")
ERROR_CODES = ("MalformedEnvelope", "UnknownStream", "PayloadDecodeFailed", "SequenceGapDetected", "Unauthorized", "InternalError")
REJECT_REASONS = ("VersionNotSupported", "ProducerIdAlreadyConnected", "Unauthorized", "ServerFull")
GATE_DECISIONS = ("Accept", "Advance", "Gap", "Duplicate")
TIMEBASE_KINDS = ("Gnss", "Ptp", "Ntp", "Local", "Other")
EVENT_KINDS = ("Detection", "DetectorHealth", "TimebaseStatus", "AdapterMetadata", "Crossing")
PROTOCOL_VERSION = 0
DERIVED_PRODUCER = "<derived>"
MAX_PRODUCER_ID_BYTES = 256

SENSOR = "kind string, rssi_dbm smallint, pulse_count bigint, operator_id string"
DETECTION = (
    "detection_id string, detector_id string, timing_point_id string, subject_id string, detected_at_ns bigint, "
    "detected_at_uncertainty_ns bigint, received_at_ns bigint, timestamping_method string, timebase_id string, "
    f"source_attestation string, sequence_number bigint, sensor struct<{', '.join(f.replace(' ', ':') for f in SENSOR.split(', '))}>"
)
CROSSING = (
    "crossing_id string, timing_point_id string, subject_id string, crossed_at_ns bigint, crossed_at_uncertainty_ns bigint, "
    "timebase_id string, timestamping_method string, source_attestation string, detection_ids array<string>"
)
DETECTOR_HEALTH = "detector_id string, reported_at_ns bigint, status struct<kind:string, reason:string>, message string"
TIMEBASE_STATUS = "timebase_id string, reported_at_ns bigint, sync_state string, uncertainty_ns bigint, source_attestation string"
STREAM = "stream_id string, kind string, detector_id string, timing_point_id string"
_STREAMS = "array<struct<" + STREAM.replace(" ", ":").replace(",:", ", ") + ">>"
ADAPTER_METADATA = (
    "detector_id string, timing_point_id string, timebase_id string, source_attestation string, declared_at_ns bigint, "
    f"capabilities struct<streams:{_STREAMS}, timestamping_method:string, declared_resolution_ns:bigint>"
)
TIMEBASE_METADATA = "timebase_id string, kind string, declared_uncertainty_ns bigint, source_attestation string, declared_at_ns bigint"
ENVELOPE = "protocol_version smallint, message_type string, source_id string, stream_id string, sequence_number bigint, correlation_id string, payload binary, traceparent string"
SEGMENT_MANIFEST = "base_offset bigint, last_offset bigint, last_appended_at_ns bigint, byte_size bigint, closed boolean"


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "smallint": T.ShortType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "array<string>": T.ArrayType(T.StringType())}


def flat(fields: str) -> T.StructType:
    """A schema without nested structs; needs no session, so workers can make it too."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def detection() -> T.StructType:
    return _struct(DETECTION)


def crossing() -> T.StructType:
    return _struct(CROSSING)


def envelope() -> T.StructType:
    return _struct(ENVELOPE)


def event() -> T.StructType:
    """The tagged union: ``kind`` and one payload that isn't null."""
    bodies = {"detection": DETECTION, "detector_health": DETECTOR_HEALTH, "timebase_status": TIMEBASE_STATUS, "adapter_metadata": ADAPTER_METADATA, "crossing": CROSSING}
    return T.StructType([T.StructField("kind", T.StringType(), False), *(T.StructField(k, _struct(v)) for k, v in bodies.items())])


def log_entry() -> T.StructType:
    return T.StructType([T.StructField("offset", T.LongType(), False), T.StructField("appended_at_ns", T.LongType()), T.StructField("producer_id", T.StringType()), *event().fields])
