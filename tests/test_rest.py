from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import builders, extensions, metrics, validate
from tidemark.sources.simulator import START_NS, simulated, simulated_stream


def test_schemas(spark):
    assert len(schema.detection()) == 12 and len(schema.crossing()) == 9 and len(schema.envelope()) == 8
    assert schema.event().fieldNames() == ["kind", "detection", "detector_health", "timebase_status", "adapter_metadata", "crossing"]
    assert spark.createDataFrame([], schema.log_entry()).columns[:3] == ["offset", "appended_at_ns", "producer_id"]


def test_simulator(spark):
    rows = simulated(spark, 6).orderBy("emitted").collect()
    assert [r.kind for r in rows[:3]] == ["AdapterMetadata", "DetectorHealth", "Detection"]
    assert [(r.timing_point_id, r.subject_id, r.sequence_number) for r in rows[2:6]] == [("tp-start", "car-1", 0), ("tp-finish", "car-2", 1), ("tp-start", "car-3", 2), ("tp-finish", "car-1", 3)]
    assert rows[-1].at_ns == START_NS + 5 * 2_000_000_000
    assert simulated(spark, 2, subjects=()).where("kind = 'Detection' AND subject_id IS NULL").count() == 2
    assert simulated_stream(spark).isStreaming


def test_metadata_first(spark):
    rows = [("a", 1, "AdapterMetadata"), ("a", 2, "Detection"), ("b", 1, "Detection"), ("b", 2, "AdapterMetadata")]
    got = validate.not_metadata_first(spark.createDataFrame(rows, "source_id string, arrival bigint, kind string")).collect()
    assert [(r.source_id, r.kind) for r in got] == [("b", "Detection")]


def connect(**kw):
    base = {"message_type": "Connect", "has_payload": True, "payload_ok": True, "protocol_version_min": 0, "protocol_version_max": 0, "auth_token": None, "correlation_id": "c"}
    return tuple((base | kw).values())


def test_handshake_order(spark):
    rows = [connect(), connect(message_type="Event"), connect(has_payload=False), connect(payload_ok=False), connect(protocol_version_min=1, protocol_version_max=2, auth_token="no")]
    df = spark.createDataFrame(rows, "message_type string, has_payload boolean, payload_ok boolean, protocol_version_min int, protocol_version_max int, auth_token string, correlation_id string")
    get = lambda allowed: {(r.outcome, r.reason) for r in validate.handshakes(df, allowed).collect()}
    errors = {("Error", "UnexpectedMessageType"), ("Error", "MissingConnectPayload"), ("Error", "DecodeFailed"), ("Rejected", "VersionNotSupported")}
    assert get([]) == errors | {("Accepted", None)}
    assert get(["t"]) == errors | {("Rejected", "Unauthorized")}


def test_sequence_numbers_and_defaults(spark):
    df = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2)], "detector_id string, arrival bigint")
    out = builders.normalised(builders.numbered(df), F.lit(5).cast("long")).orderBy("arrival").collect()
    assert [(r.detection_id, r.sequence_number, r.received_at_ns, r.timebase_id, r.sensor.kind) for r in out] == [("x-0", 0, 5, "local", "LoopTransponder"), ("y-0", 0, 5, "local", "LoopTransponder"), ("x-1", 1, 5, "local", "LoopTransponder")]


def test_rendering(spark):
    none = spark.createDataFrame([], "producer_id string, value bigint, is_overflow boolean")
    lines = [r.line for r in metrics.rendered(none, ["producer_id"], "gaps_total", "counter", "Gaps.").orderBy("line_no").collect()]
    assert lines[:3] == ["# HELP gaps_total Gaps.", "# TYPE gaps_total counter", "gaps_total 0"] and lines[-1] == "gaps_overflow_total 0"
    some = spark.createDataFrame([('a"b', 2, False), (None, 7, True)], "producer_id string, value bigint, is_overflow boolean")
    lines = [r.line for r in metrics.rendered(some, ["producer_id"], "active", "gauge", "Sessions.").orderBy("line_no").collect()]
    assert 'active{producer_id="a\\"b"} 2' in lines and lines[-1] == "active_overflow 7"


def test_asof_any_bucket(spark):
    d = spark.createDataFrame([("t", 5, 1), ("t", 50, 2), ("t", 51, 3), ("u", 9, 4), ("t", 1, 5)], "timebase_id string, detected_at_ns bigint, k bigint")
    s = spark.createDataFrame([("t", 2, "Locked"), ("t", 50, "Holdover"), ("v", 1, "Locked")], "timebase_id string, reported_at_ns bigint, sync_state string")
    for bucket in (1, 10, 1000):
        got = {r.k: r.sync_state for r in extensions.asof_timebase(d, s, bucket).collect()}
        assert got == {1: "Locked", 2: "Holdover", 3: "Holdover", 4: None, 5: None}
