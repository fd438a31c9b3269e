"""The engine's operators as queries over the events table, each with DuckDB SQL that computes the same independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import builders, crossings, extensions, gate, log, metrics, validate
from .operators import ingest as wire
from .plans.service import Ingested, ingest
from .sources.events import WINDOW_NS, detections
from .sources.shared import scratch
from .sources.simulator import START_NS, simulated

Query = Callable[[SparkSession, str], DataFrame]
TABLE: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        TABLE[f.__name__] = (f, sql)
        return f

    return keep


def _ingested(spark: SparkSession, sf_dir: str, emit_open: bool = False) -> Ingested:
    return ingest(detections(spark, sf_dir), WINDOW_NS, emit_open=emit_open)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


_DET = """WITH RECURSIVE base AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
det AS (SELECT 'd-' || event_id AS detection_id, 'prod-' || event_type AS producer_id, 'det-' || event_type AS detector_id, 'tp-' || event_type AS timing_point_id,
  CASE WHEN event_type <> 'error' THEN 'subj-' || user_id END AS subject_id, epoch_us(ts) * 1000 AS detected_at_ns,
  CASE WHEN event_id % 3 <> 0 THEN event_id % 7 * 1000000 END AS u, 'tb-' || (event_id % 3) AS timebase_id,
  CASE WHEN event_id % 2 = 0 THEN 'RuntimeDiscovered' ELSE 'OperatorAsserted' END AS source_attestation,
  rn + CAST(floor(rn / 50.0) AS BIGINT) AS sequence_number,
  CASE WHEN event_type IN ('click', 'view') AND event_id % 5 <> 0 THEN CAST(floor(value) AS BIGINT) % 70 - 100 END AS rssi,
  unnest(CASE WHEN event_id % 17 = 0 THEN [event_id * 2, event_id * 2 + 41] ELSE [event_id * 2] END) AS arrival FROM base),
marked AS (SELECT *, max(sequence_number) OVER (PARTITION BY producer_id, detector_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high_water FROM det),
decided AS (SELECT *, CASE WHEN high_water IS NULL THEN 'Accept' WHEN sequence_number <= high_water THEN 'Duplicate' WHEN sequence_number = high_water + 1 THEN 'Advance' ELSE 'Gap' END AS decision FROM marked),
good AS (SELECT * FROM decided WHERE decision <> 'Duplicate')"""
_GROUPS = f"""{_DET},
named AS (SELECT *, row_number() OVER (PARTITION BY timing_point_id, subject_id ORDER BY arrival) AS k FROM good WHERE subject_id IS NOT NULL),
walk AS (SELECT timing_point_id, subject_id, k, detected_at_ns AS anchor, 1 AS g FROM named WHERE k = 1
  UNION ALL SELECT n.timing_point_id, n.subject_id, n.k, CASE WHEN n.detected_at_ns - w.anchor > {WINDOW_NS} THEN n.detected_at_ns ELSE w.anchor END,
    CASE WHEN n.detected_at_ns - w.anchor > {WINDOW_NS} THEN w.g + 1 ELSE w.g END
  FROM walk w JOIN named n ON n.timing_point_id = w.timing_point_id AND n.subject_id = w.subject_id AND n.k = w.k + 1),
folded AS (SELECT n.timing_point_id, n.subject_id, w.g,
    CASE WHEN count(n.rssi) > 0 THEN arg_max(struct_pack(t := n.detected_at_ns, u := n.u, tb := n.timebase_id, sa := n.source_attestation), struct_pack(r := coalesce(n.rssi, -32768), a := n.arrival))
      ELSE arg_min(struct_pack(t := n.detected_at_ns, u := n.u, tb := n.timebase_id, sa := n.source_attestation), struct_pack(r := n.detected_at_ns, a := n.arrival)) END AS p,
    max(n.detected_at_ns) - min(n.detected_at_ns) AS span, list(n.detection_id ORDER BY n.arrival) AS ids, min(n.arrival) AS first_arrival
  FROM named n JOIN walk w USING (timing_point_id, subject_id, k) GROUP BY n.timing_point_id, n.subject_id, w.g),
closing AS (SELECT *, lead(first_arrival) OVER (PARTITION BY timing_point_id, subject_id ORDER BY g) AS trigger_arrival FROM folded),
made AS (
  SELECT timing_point_id, subject_id, p.t AS crossed_at_ns, CASE WHEN span > 0 THEN greatest(p.u, span) ELSE p.u END AS crossed_at_uncertainty_ns, p.tb AS timebase_id, p.sa AS source_attestation,
    ids, first_arrival, trigger_arrival, trigger_arrival IS NULL AS is_open FROM closing
  UNION ALL SELECT timing_point_id, subject_id, detected_at_ns, u, timebase_id, source_attestation, [detection_id], arrival, arrival, false FROM good WHERE subject_id IS NULL),
crossing AS (SELECT md5(timing_point_id || chr(31) || coalesce(subject_id, '') || chr(31) || ids[1]) AS crossing_id, *, array_to_string(ids, ',') AS detection_ids FROM made)"""
_CROSSING = "crossing_id, timing_point_id, subject_id, crossed_at_ns, crossed_at_uncertainty_ns, timebase_id, source_attestation, detection_ids, first_arrival, trigger_arrival, is_open"
_LOG = f"""{_GROUPS},
entry AS (SELECT arrival AS trigger_arrival, false AS is_derived, detection_id AS tie, producer_id, 'Detection' AS kind, detection_id, NULL::VARCHAR AS crossing_id, timing_point_id, subject_id, detected_at_ns AS at_ns FROM good
  UNION ALL SELECT c.trigger_arrival, true, c.crossing_id, g.producer_id, 'Crossing', NULL, c.crossing_id, c.timing_point_id, c.subject_id, c.crossed_at_ns FROM crossing c JOIN good g ON g.arrival = c.trigger_arrival WHERE NOT c.is_open),
log AS (SELECT row_number() OVER (ORDER BY trigger_arrival, is_derived, tie) - 1 AS "offset", * EXCLUDE (tie) FROM entry)"""
_LOG_COLUMNS = '"offset", trigger_arrival, is_derived, producer_id, kind, detection_id, crossing_id, timing_point_id, subject_id, at_ns'


def _shown(df: DataFrame) -> DataFrame:
    joined = F.array_join("detection_ids", ",").alias("detection_ids")
    return df.select(*[joined if c == "detection_ids" else F.col(c) for c in _CROSSING.split(", ")])


@query(f"{_DET} SELECT detection_id, producer_id, detector_id, arrival, sequence_number, high_water, CASE WHEN decision = 'Gap' THEN high_water + 1 END AS expected, CASE WHEN decision = 'Gap' THEN sequence_number - high_water - 1 END AS missing, decision FROM decided")
def gate_decisions(spark, sf_dir):
    return gate.gate_decisions(detections(spark, sf_dir)).select("detection_id", "producer_id", "detector_id", "arrival", "sequence_number", "high_water", "expected", "missing", "decision")


@query(f"{_DET} SELECT detection_id, producer_id, arrival, sequence_number FROM good")
def gate_accepted(spark, sf_dir):
    return _ingested(spark, sf_dir).accepted.select("detection_id", "producer_id", "arrival", "sequence_number")


@query(f"{_DET} SELECT producer_id, detector_id, max(sequence_number) AS high_water FROM good GROUP BY ALL")
def gate_high_water(spark, sf_dir):
    return gate.high_water(_ingested(spark, sf_dir).accepted)


@query(f"{_DET}, seed AS (SELECT producer_id, detector_id, max(sequence_number) AS s FROM det WHERE arrival < 1000 GROUP BY ALL), late AS (SELECT d.*, greatest(max(d.sequence_number) OVER (PARTITION BY d.producer_id, d.detector_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s) AS hw FROM det d LEFT JOIN seed USING (producer_id, detector_id) WHERE d.arrival >= 1000) SELECT detection_id, arrival, hw AS high_water, CASE WHEN hw IS NULL THEN 'Accept' WHEN sequence_number <= hw THEN 'Duplicate' WHEN sequence_number = hw + 1 THEN 'Advance' ELSE 'Gap' END AS decision FROM late")
def gate_restart(spark, sf_dir):
    d = detections(spark, sf_dir)
    seed = gate.high_water(gate.accepted(gate.gate_decisions(d.where("arrival < 1000"))))
    return gate.gate_decisions(d.where("arrival >= 1000"), seed).select("detection_id", "arrival", "high_water", "decision")


@query(f"{_DET} SELECT producer_id, detector_id, arrival, high_water + 1 AS expected, sequence_number AS got, sequence_number - high_water - 1 AS missing FROM decided WHERE decision = 'Gap'")
def sequence_gaps(spark, sf_dir):
    return _ingested(spark, sf_dir).decided.where("decision = 'Gap'").select("producer_id", "detector_id", "arrival", "expected", F.col("sequence_number").alias("got"), "missing")


@query(f"{_GROUPS} SELECT {_CROSSING} FROM crossing WHERE NOT is_open")
def crossings_service(spark, sf_dir):
    return _shown(_ingested(spark, sf_dir).crossings)


@query(f"{_GROUPS} SELECT {_CROSSING} FROM crossing")
def crossings_flushed(spark, sf_dir):
    return _shown(_ingested(spark, sf_dir, True).crossings)


@query(f"{_GROUPS} SELECT {_CROSSING} FROM crossing WHERE subject_id IS NULL")
def crossings_anonymous(spark, sf_dir):
    made = crossings.anonymous_crossings(_ingested(spark, sf_dir).accepted)
    ident = crossings.crossing_id(F.col("timing_point_id"), F.col("subject_id"), F.element_at("detection_ids", 1))
    return _shown(made.select(ident.alias("crossing_id"), *made.columns))


@query(f"{_LOG} SELECT {_LOG_COLUMNS} FROM log")
def log_entries(spark, sf_dir):
    return _ingested(spark, sf_dir).log


@query(f'{_LOG} SELECT {_LOG_COLUMNS} FROM log WHERE "offset" >= 300 AND "offset" < 550')
def log_range(spark, sf_dir):
    return log.read_range(_ingested(spark, sf_dir).log, 300, 550)


@query(f'{_LOG} SELECT {_LOG_COLUMNS.replace("producer_id, ", "")} FROM log WHERE "offset" >= 200 AND "offset" < 1200')
def log_page(spark, sf_dir):
    return log.page(_ingested(spark, sf_dir).log, 200, 5000)


@query(f'{_LOG} SELECT min("offset") AS earliest_offset, max("offset") AS latest_offset FROM log')
def log_bounds(spark, sf_dir):
    return log.bounds(_ingested(spark, sf_dir).log)


_MANIFEST = """SELECT o // 500 * 500 AS base_offset, max(o) AS last_offset, max(event_id) * 1000000000 AS last_appended_at_ns, CAST(sum(length(props) + 40) AS BIGINT) AS byte_size, max(o) < (SELECT count(*) FROM events) - 1 AS closed
FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS o FROM events) GROUP BY o // 500"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", "props", F.col("event_id").alias("trigger_arrival"), F.lit(False).alias("is_derived"), F.col("event_id").alias("tie"))
    numbered = log.with_offsets(rows)
    last = F.max("last_offset").over(Window.orderBy("base_offset").rowsBetween(1, 1))
    sums = numbered.groupBy((F.expr("offset div 500") * 500).alias("base_offset")).agg(F.max("offset").alias("last_offset"), (F.max("event_id") * 1_000_000_000).alias("last_appended_at_ns"), F.sum(F.length("props") + 40).alias("byte_size"))
    return sums.withColumn("closed", last.isNotNull())


def _retention(time: bool, size: bool) -> tuple[str, Callable[[DataFrame], DataFrame]]:
    timely = "coalesce(max((NOT closed OR last_appended_at_ns >= 3000000000000 - 1500000000000)::INT) OVER (ORDER BY base_offset), 0) = 1" if time else "true"
    small = "NOT closed OR sum(CASE WHEN timely THEN byte_size ELSE 0 END) OVER (ORDER BY base_offset DESC) <= 150000" if size else "true"
    sql = f"WITH m AS ({_MANIFEST}), t AS (SELECT *, {timely} AS timely FROM m) SELECT base_offset, last_offset, last_appended_at_ns, byte_size, closed, timely AND ({small}) AS keep FROM t"
    return sql, lambda m: log.retained(m, 3_000_000_000_000, 1_500_000_000_000 if time else None, 150_000 if size else None)


for _name, _how in {"retention_time": (True, False), "retention_size": (False, True), "retention_hybrid": (True, True)}.items():
    _sql, _apply = _retention(*_how)
    TABLE[_name] = (lambda spark, sf_dir, f=_apply: f(_manifest(spark, sf_dir)), _sql)


@query(f"{_LOG} SELECT CASE WHEN is_derived THEN '<derived>' ELSE producer_id END AS producer_id, kind AS event_kind, count(*) AS value FROM log GROUP BY ALL")
def metrics_appended(spark, sf_dir):
    return metrics.events_appended(_ingested(spark, sf_dir).log)


@query(f"{_DET} SELECT producer_id, detector_id, count(*) AS value FROM decided WHERE decision = 'Duplicate' GROUP BY ALL")
def metrics_duplicates(spark, sf_dir):
    return metrics.duplicates_dropped(_ingested(spark, sf_dir).decided)


@query(f"{_DET} SELECT producer_id, detector_id, count(*) AS value FROM decided WHERE decision = 'Gap' GROUP BY ALL")
def metrics_gaps(spark, sf_dir):
    return metrics.sequence_gaps(_ingested(spark, sf_dir).decided)


_SETS = "SELECT 'p-' || user_id AS producer_id, event_type AS event_kind, event_id, 1 AS one FROM events"
_CAPPED = f"""WITH s AS ({_SETS}), f AS (SELECT producer_id, event_kind, min(event_id) AS first, CAST(sum(one) AS BIGINT) AS value FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY first, producer_id, event_kind) AS rank FROM f),
c AS (SELECT producer_id, event_kind, value, false AS is_overflow FROM r WHERE rank <= 50 UNION ALL SELECT NULL, NULL, CAST(coalesce(sum(value), 0) AS BIGINT), true FROM r WHERE rank > 50)"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.capped(_events(spark, sf_dir).selectExpr("concat('p-', user_id) AS producer_id", "event_type AS event_kind", "event_id", "1 AS one"), ["producer_id", "event_kind"], "event_id", "one", 50)


@query(f"{_CAPPED} SELECT * FROM c")
def metrics_capped(spark, sf_dir):
    return _sets(spark, sf_dir)


@query(f"""{_CAPPED}, l AS (SELECT 0 AS part, '# HELP events_appended_total Events appended to the log.' AS line UNION ALL SELECT 1, '# TYPE events_appended_total counter'
UNION ALL SELECT 3, 'events_appended_total{{event_kind="' || event_kind || '",producer_id="' || producer_id || '"}} ' || value FROM c WHERE NOT is_overflow
UNION ALL SELECT 4, '# HELP events_appended_overflow_total Label sets dropped beyond 50 series of events_appended_total.' UNION ALL SELECT 5, '# TYPE events_appended_overflow_total counter'
UNION ALL SELECT 6, 'events_appended_overflow_total ' || value FROM c WHERE is_overflow) SELECT row_number() OVER (ORDER BY part, line) AS line_no, line FROM l""")
def metrics_rendered(spark, sf_dir):
    return metrics.rendered(_sets(spark, sf_dir), ["producer_id", "event_kind"], "events_appended_total", "counter", "Events appended to the log.", 50)


_SESSIONS = "SELECT concat('listener-', user_id % 3) AS listener, CASE WHEN event_type = 'signup' THEN -1 ELSE 1 END AS delta FROM events WHERE event_type IN ('signup', 'purchase')"


def _from(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=_events(spark, sf_dir))


@query(f"SELECT listener, CAST(sum(delta) AS BIGINT) AS value FROM ({_SESSIONS}) GROUP BY 1")
def metrics_sessions_active(spark, sf_dir):
    return metrics.sessions_active(_from(spark, sf_dir, _SESSIONS))


@query(f"SELECT listener, count(*) AS value FROM ({_SESSIONS}) WHERE delta > 0 GROUP BY 1")
def metrics_sessions_total(spark, sf_dir):
    return metrics.sessions_total(_from(spark, sf_dir, _SESSIONS))


_CONNECTS = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'Event' ELSE 'Connect' END AS message_type, event_id % 13 <> 0 AS has_payload, event_id % 17 <> 0 AS payload_ok,
CAST(event_id % 3 AS SMALLINT) AS protocol_version_min, CAST(event_id % 5 AS SMALLINT) AS protocol_version_max, CASE WHEN event_id % 4 <> 0 THEN concat('token-', event_id % 6) END AS auth_token, concat('c-', event_id) AS correlation_id FROM events"""
_REASON = """CASE WHEN message_type <> 'Connect' THEN 'UnexpectedMessageType' WHEN NOT has_payload THEN 'MissingConnectPayload' WHEN NOT payload_ok THEN 'DecodeFailed'
WHEN NOT (0 BETWEEN protocol_version_min AND protocol_version_max) THEN 'VersionNotSupported' WHEN auth_token IS NULL OR auth_token NOT IN ('token-1', 'token-2') THEN 'Unauthorized' END"""


@query(f"""WITH c AS ({_CONNECTS}), r AS (SELECT *, {_REASON} AS reason FROM c), o AS (SELECT *, CASE WHEN reason IS NULL THEN 'Accepted' WHEN reason IN ('VersionNotSupported', 'Unauthorized') THEN 'Rejected' ELSE 'Error' END AS outcome FROM r)
SELECT event_id, outcome, reason, CASE WHEN outcome <> 'Error' THEN 'server' END AS reply_source_id, CASE WHEN outcome <> 'Error' THEN correlation_id END AS reply_correlation_id, CAST(CASE WHEN outcome = 'Accepted' THEN 0 END AS INTEGER) AS negotiated_version FROM o""")
def handshake_outcomes(spark, sf_dir):
    out = validate.handshakes(_from(spark, sf_dir, _CONNECTS), ["token-1", "token-2"])
    return out.select("event_id", "outcome", "reason", "reply_source_id", "reply_correlation_id", "negotiated_version")


_TRACES = """CASE event_id % 10 WHEN 0 THEN concat('00-', md5(CAST(event_id AS VARCHAR(20))), '-', substring(md5(event_type), 1, 16), '-01') WHEN 1 THEN concat('00-', md5(CAST(event_id AS VARCHAR(20))), '-00f067aa0ba902b7-0')
WHEN 2 THEN concat('00_', md5(CAST(event_id AS VARCHAR(20))), '-00f067aa0ba902b7-01') WHEN 3 THEN concat('00-', upper(md5(CAST(event_id AS VARCHAR(20)))), '-00f067aa0ba902b7-01')
WHEN 4 THEN concat('ff-', md5(CAST(event_id AS VARCHAR(20))), '-00f067aa0ba902b7-01') WHEN 5 THEN '00-00000000000000000000000000000000-00f067aa0ba902b7-01'
WHEN 6 THEN concat('00-', md5(CAST(event_id AS VARCHAR(20))), '-0000000000000000-01') WHEN 7 THEN concat('cc-', md5(CAST(event_id AS VARCHAR(20))), '-00f067aa0ba902b7-ff') WHEN 8 THEN 'ü' ELSE NULL END"""
_TRACED = f"SELECT event_id, {_TRACES} AS traceparent FROM events"
_HEX = "'^[0-9a-f]{2}-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}$'"
_TRACE_ERROR = f"""CASE WHEN traceparent IS NULL THEN NULL WHEN strlen(traceparent) <> 55 THEN 'Length' WHEN substring(traceparent, 3, 1) <> '-' OR substring(traceparent, 36, 1) <> '-' OR substring(traceparent, 53, 1) <> '-' THEN 'Structure'
WHEN NOT regexp_full_match(traceparent, {_HEX}) THEN 'Hex' WHEN traceparent LIKE 'ff%' THEN 'Version' WHEN substring(traceparent, 4, 32) = repeat('0', 32) THEN 'TraceId' WHEN substring(traceparent, 37, 16) = repeat('0', 16) THEN 'ParentId' END"""


@query(f"""WITH t AS ({_TRACED}), e AS (SELECT *, {_TRACE_ERROR} AS error FROM t) SELECT event_id, error, traceparent IS NOT NULL AND error IS NULL AS valid,
CASE WHEN error IS NULL THEN substring(traceparent, 1, 2) END AS version, CASE WHEN error IS NULL THEN substring(traceparent, 4, 32) END AS trace_id, CASE WHEN error IS NULL THEN substring(traceparent, 37, 16) END AS parent_id, CASE WHEN error IS NULL THEN substring(traceparent, 54, 2) END AS flags FROM e""")
def traceparent_parse(spark, sf_dir):
    t = _from(spark, sf_dir, _TRACED)
    p = S.parse_traceparent("traceparent")
    return t.select("event_id", S.traceparent_error("traceparent").alias("error"), S.is_valid_traceparent("traceparent").alias("valid"), p["version"].alias("version"), p["trace_id"].alias("trace_id"), p["parent_id"].alias("parent_id"), p["flags"].alias("flags"))


@query("""SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN '00-' || lpad(to_hex(event_id % 7), 32, '0') || '-' || lpad(to_hex(event_id % 5), 16, '0') || '-' || lpad(to_hex(event_id % 2), 2, '0') END AS traceparent FROM events""")
def traceparent_format(spark, sf_dir):
    h = lambda n: F.hex((F.col("event_id") % n).cast("long"))
    return _events(spark, sf_dir).select("event_id", S.format_traceparent(h(7), h(5), h(2)).alias("traceparent"))


_HEADERS = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN concat('Bearer t-', event_id) WHEN 1 THEN concat('bEARER  \t t-', event_id, ' ') WHEN 2 THEN 'Basic abc' WHEN 3 THEN 'Bearer' WHEN 4 THEN 'Bearer   ' WHEN 5 THEN concat('Bearert-', event_id) WHEN 6 THEN concat(' bearer\ttwo words ', event_id) ELSE NULL END AS header FROM events"""


@query(f"WITH h AS ({_HEADERS}) SELECT event_id, nullif(regexp_extract(header, '(?is)^[ \\t]*bearer[ \\t]+(.*?)[ \\t]*$', 1), '') AS token FROM h")
def bearer_parse(spark, sf_dir):
    return _from(spark, sf_dir, _HEADERS).select("event_id", S.parse_bearer_token("header").alias("token"))


_ENVELOPES = f"""SELECT event_id AS arrival, concat('s-', user_id) AS session, concat('p-', user_id) AS registered_id, CAST(CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS protocol_version,
concat('p-', CASE WHEN event_id % 31 = 0 THEN 0 ELSE user_id END) AS source_id, CASE event_type WHEN 'view' THEN 'Heartbeat' WHEN 'error' THEN CASE WHEN event_id % 4 = 0 THEN 'Disconnect' ELSE 'Event' END WHEN 'signup' THEN CASE WHEN event_id % 9 = 0 THEN 'Connect' ELSE 'Event' END ELSE 'Event' END AS message_type,
event_id % 23 <> 0 AND NOT (event_type = 'error' AND event_id % 4 = 0 AND event_id % 8 <> 0) AS has_payload, event_id % 37 <> 0 AS payload_ok, event_id, {_TRACES} AS traceparent FROM events"""
_DISPATCH = f"""WITH t AS ({_ENVELOPES}), d AS (SELECT *, CASE WHEN protocol_version <> 0 THEN 'VersionMismatch' WHEN source_id <> registered_id THEN 'SourceMismatch' WHEN message_type = 'Event' AND NOT has_payload THEN 'MissingEventPayload'
WHEN message_type = 'Heartbeat' AND NOT has_payload THEN 'MissingHeartbeatPayload' WHEN message_type IN ('Event', 'Heartbeat') AND NOT payload_ok THEN 'DecodeFailed' WHEN message_type = 'Disconnect' AND has_payload THEN 'UnexpectedDisconnectPayload'
WHEN message_type NOT IN ('Event', 'Heartbeat', 'Disconnect') THEN 'UnexpectedMessageType' END AS error, {_TRACE_ERROR} AS bad FROM t),
a AS (SELECT session, arrival, coalesce(CASE WHEN error IS NULL THEN message_type END, 'Error') AS action, error, CASE WHEN bad IS NULL THEN traceparent END AS traceparent FROM d)"""


def _dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.dispatched(_from(spark, sf_dir, _ENVELOPES)).select("session", "arrival", "action", "error", "traceparent")


@query(f"{_DISPATCH} SELECT * FROM a")
def dispatch_outcomes(spark, sf_dir):
    return _dispatched(spark, sf_dir)


@query(f"{_DISPATCH} SELECT * FROM a QUALIFY coalesce(max((action IN ('Error', 'Disconnect'))::INT) OVER (PARTITION BY session ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0")
def session_termination(spark, sf_dir):
    return validate.until_end(_dispatched(spark, sf_dir))


@query(f"{_DISPATCH} SELECT * FROM a WHERE action = 'Event'")
def surfaced_events(spark, sf_dir):
    return validate.surfaced(_dispatched(spark, sf_dir))


@query(f"{_DISPATCH} SELECT * FROM a WHERE action = 'Error'")
def quarantined_envelopes(spark, sf_dir):
    return validate.quarantined(_dispatched(spark, sf_dir))


_KINDS = "SELECT concat('src-', user_id) AS source_id, event_id AS arrival, CASE WHEN event_type = 'signup' THEN 'AdapterMetadata' WHEN event_type = 'error' THEN 'DetectorHealth' ELSE 'Detection' END AS kind FROM events"


@query(f"SELECT source_id, arrival, kind FROM ({_KINDS}) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY arrival) = 1 AND kind <> 'AdapterMetadata'")
def metadata_first_violations(spark, sf_dir):
    return validate.not_metadata_first(_from(spark, sf_dir, _KINDS))


@query(f"""SELECT range AS emitted, CASE WHEN range = 0 THEN 'AdapterMetadata' WHEN range = 1 THEN 'DetectorHealth' ELSE 'Detection' END AS kind, 'sim-1' AS detector_id,
CASE WHEN range < 2 OR (range - 2) % 2 = 0 THEN 'tp-start' ELSE 'tp-finish' END AS timing_point_id, CASE WHEN range >= 2 THEN 'car-' || ((range - 2) % 3 + 1) END AS subject_id, CASE WHEN range >= 2 THEN range - 2 END AS sequence_number, greatest(range - 2, 0) * 2000000000 + {START_NS} AS at_ns FROM range(5002)""")
def simulator_detections(spark, sf_dir):
    return simulated(spark, 5000)


_BARE = "SELECT concat('det-', event_type) AS detector_id, event_id AS arrival, CASE WHEN event_id % 3 = 0 THEN concat('own-', event_id) END AS detection_id, CASE WHEN event_id % 2 = 0 THEN 'gps-1' END AS timebase_id FROM events"


@query(f"""WITH b AS ({_BARE}), n AS (SELECT *, row_number() OVER (PARTITION BY detector_id ORDER BY arrival) - 1 AS sequence_number FROM b)
SELECT detector_id, arrival, sequence_number, coalesce(detection_id, detector_id || '-' || sequence_number) AS detection_id, coalesce(timebase_id, 'local') AS timebase_id, 'AdapterReceiveTime' AS timestamping_method, 'OperatorAsserted' AS source_attestation, CAST(77 AS BIGINT) AS received_at_ns, 'LoopTransponder' AS sensor_kind FROM n""")
def builder_defaults(spark, sf_dir):
    out = builders.normalised(builders.numbered(_from(spark, sf_dir, _BARE)), F.lit(77).cast("long"))
    return out.select("detector_id", "arrival", "sequence_number", "detection_id", "timebase_id", "timestamping_method", "source_attestation", "received_at_ns", F.col("sensor.kind").alias("sensor_kind"))


_LABELS = "SELECT event_id, concat('a\\\\b\"c', chr(10), 'd', chr(13), event_type) AS label, CASE WHEN event_id % 2 = 0 THEN 'x_total' ELSE 'active' END AS name, event_id % 7 AS a, event_id % 11 AS b FROM events"


@query("""SELECT event_id, replace(replace(replace(replace('a\\b"c' || chr(10) || 'd' || chr(13) || event_type, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r') AS escaped,
CASE WHEN event_id % 2 = 0 THEN 'x_overflow_total' ELSE 'active_overflow' END AS overflow_name, greatest(event_id % 7 - event_id % 11, 0) AS less, CASE WHEN event_id % 7 = 0 THEN 9223372036854775807 ELSE event_id % 7 + event_id % 11 END AS more,
CASE WHEN event_id % 7 <> 0 THEN event_id % 7 + 1 END AS next FROM events""")
def scalar_functions(spark, sf_dir):
    t = _events(spark, sf_dir).withColumns({"a": F.col("event_id") % 7, "b": F.col("event_id") % 11, "label": F.concat(F.lit('a\\b"c\nd\r'), "event_type"), "name": F.when(F.col("event_id") % 2 == 0, "x_total").otherwise("active")})
    top = F.when(F.col("a") == 0, F.lit(2**63 - 1)).otherwise(F.col("a"))
    return t.select("event_id", S.escape_label_value("label").alias("escaped"), S.overflow_metric_name("name").alias("overflow_name"), S.saturating_sub("a", "b").alias("less"), S.saturating_add(top, F.when(F.col("a") == 0, F.lit(1)).otherwise(F.col("b"))).alias("more"), S.checked_next(top).alias("next"))


@query(f"{_GROUPS} SELECT c.crossing_id, i - 1 AS place, g.detection_id, g.detector_id, g.sequence_number FROM (SELECT crossing_id, unnest(ids) AS detection_id, generate_subscripts(ids, 1) AS i FROM crossing WHERE NOT is_open) c JOIN good g USING (detection_id)")
def crossing_lineage(spark, sf_dir):
    made = _ingested(spark, sf_dir)
    return extensions.crossing_lineage(made.crossings, made.accepted).select("crossing_id", F.col("place").cast("long").alias("place"), "detection_id", "detector_id", "sequence_number")


_STATUS = "SELECT concat('tb-', event_id % 3) AS timebase_id, {ns} AS reported_at_ns, CASE WHEN event_id % 5 = 0 THEN 'Holdover' ELSE 'Locked' END AS sync_state FROM events WHERE event_type = 'signup'"


@query(f"{_DET}, st AS ({_STATUS.format(ns='epoch_us(ts) * 1000')}) SELECT d.detection_id, d.arrival, s.sync_state, d.detected_at_ns - s.reported_at_ns AS age_ns FROM det d ASOF LEFT JOIN st s ON d.timebase_id = s.timebase_id AND d.detected_at_ns >= s.reported_at_ns")
def detection_asof_timebase(spark, sf_dir):
    events = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    statuses = spark.sql(_STATUS.format(ns="unix_micros(ts) * 1000").replace("FROM events", "FROM {events}"), events=events)
    return extensions.asof_timebase(detections(spark, sf_dir), statuses, 86_400_000_000_000).select("detection_id", "arrival", "sync_state", (F.col("detected_at_ns") - F.col("status_at_ns")).alias("age_ns"))


@query(f"""{_LOG} SELECT node || ':' || "offset" AS entry_id, node AS node_id, node || ':' || producer_id AS producer_id, kind FROM log, (VALUES ('north'), ('south')) n(node) WHERE (node = 'north') = ("offset" % 2 = 0)""")
def federated_log(spark, sf_dir):
    entries = _ingested(spark, sf_dir).log
    return extensions.federated({"north": entries.where("offset % 2 = 0"), "south": entries.where("offset % 2 = 1")}).select("entry_id", "node_id", "producer_id", "kind")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def amendments(spark, sf_dir):
    return extensions.amended(_events(spark, sf_dir).select("user_id", "event_id", "value"), "user_id", "event_id")


@query(f"""{_GROUPS} SELECT timing_point_id, subject_id, crossing_id, row_number() OVER w AS lap, crossed_at_ns - lag(crossed_at_ns) OVER w AS lap_ns FROM crossing WHERE NOT is_open AND subject_id IS NOT NULL WINDOW w AS (PARTITION BY timing_point_id, subject_id ORDER BY crossed_at_ns, crossing_id)""")
def laps(spark, sf_dir):
    return extensions.laps(_ingested(spark, sf_dir).crossings)


@query(f"{_DET} SELECT detection_id, arrival, source_attestation FROM det WHERE source_attestation = 'RuntimeDiscovered'")
def discovered_only(spark, sf_dir):
    return extensions.discovered_only(detections(spark, sf_dir)).select("detection_id", "arrival", "source_attestation")


_DECLARED = "SELECT concat('det-', user_id) AS detector_id, event_id AS declared_at_ns, concat('tp-', event_type) AS timing_point_id FROM events"


@query(f"SELECT * FROM ({_DECLARED}) QUALIFY row_number() OVER (PARTITION BY detector_id ORDER BY declared_at_ns DESC) = 1")
def detector_registry(spark, sf_dir):
    return extensions.detector_registry(_from(spark, sf_dir, _DECLARED))


def streamed(spark: SparkSession, sf_dir: str, folder: str, files: int = 3) -> DataFrame:
    """The log that the stream makes of the events, read in ``files`` micro-batches."""
    from .streaming.pipeline import run_log, use_rocksdb

    use_rocksdb(spark)
    rows = detections(spark, sf_dir)
    rows.write.parquet(f"{folder}/arrived")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/arrived")
    low, high = rows.agg(F.min("arrival"), F.max("arrival")).first()
    kept = log.EventLog(spark, f"{folder}/log")
    for k in range(files):  # a stretch of arrivals is a micro-batch, of as many files as tasks wrote
        a, b = low + (high + 1 - low) * k // files, low + (high + 1 - low) * (k + 1) // files
        rows.where((F.col("arrival") >= a) & (F.col("arrival") < b)).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        run_log(source, kept, f"{folder}/checkpoint", lambda batch: batch, WINDOW_NS).awaitTermination()
    return kept.read_range(0)


@query(f"{_LOG} SELECT {_LOG_COLUMNS} FROM log")
def streaming_log(spark, sf_dir):
    return streamed(spark, sf_dir, scratch(spark, "stream")).select(*_NAMES)


_HEARD = _LOG.replace("marked AS (SELECT", """heard AS (SELECT * FROM det QUALIFY max((CAST(substr(detection_id, 3) AS BIGINT) % 97 = 0 OR CAST(substr(detection_id, 3) AS BIGINT) % 131 = 0)::INT)
  OVER (PARTITION BY producer_id, arrival // 500 ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 0),
marked AS (SELECT""", 1).replace("AS high_water FROM det)", "AS high_water FROM heard)")


def recorded(spark: SparkSession, sf_dir: str, framing: str) -> DataFrame:
    """The frames of the events' sessions as they come off the wire. Of some the version is wrong, of some the payload is cut."""
    from .sources.frames import FrameSource

    spark.dataSource.register(FrameSource)
    path, e = scratch(spark, "frames"), F.substring("detection_id", 3, 20).cast("long")
    sent = wire.with_payloads(detections(spark, sf_dir)).select(
        F.when(e % 97 == 0, 1).otherwise(0).cast("smallint").alias("protocol_version"), F.lit("Event").alias("message_type"), F.col("producer_id").alias("source_id"),
        F.concat("producer_id", F.lit("/"), F.expr("arrival div 500").cast("string")).alias("stream_id"), F.col("arrival").alias("sequence_number"), F.lit(None).cast("string").alias("correlation_id"),
        F.when(e % 131 == 0, F.substring("payload", 1, 9)).otherwise(F.col("payload")).alias("payload"), F.lit(None).cast("string").alias("traceparent"),
    )
    sent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "stream_id").sortWithinPartitions("stream_id", "sequence_number").write.format("frames").option("framing", framing).mode("append").save(path)
    return spark.read.format("frames").option("framing", framing).load(path)


def _heard(frames: DataFrame) -> DataFrame:
    good = frames.where("error IS NULL").withColumnsRenamed({"stream_id": "session", "sequence_number": "arrival"})
    # Decoded once: the gate and the offsets read their rows more than once.
    path = scratch(frames.sparkSession, "received")
    wire.received(good.withColumn("registered_id", F.col("source_id"))).write.parquet(path)
    return ingest(frames.sparkSession.read.parquet(path), WINDOW_NS).log


@query(f"{_HEARD} SELECT {_LOG_COLUMNS} FROM log")
def frames_to_log(spark, sf_dir):
    return _heard(recorded(spark, sf_dir, "stream"))


@query(f"{_HEARD} SELECT {_LOG_COLUMNS} FROM log")
def serial_frames_to_log(spark, sf_dir):
    return _heard(recorded(spark, sf_dir, "serial"))


_ENTRIES = "SELECT row_number() OVER (ORDER BY event_id) - 1 AS o, event_id * 10 AS appended_at_ns, 'p-' || user_id AS producer_id, props FROM events"


@query(f'SELECT o AS "offset", appended_at_ns, producer_id, props AS event FROM ({_ENTRIES}) WHERE o < (SELECT count(*) FROM events) - 1')
def segments_import(spark, sf_dir):
    """Segment files, the last one torn within its last record."""
    from .sources.frames import SegmentSource, _files, opened

    spark.dataSource.register(SegmentSource)
    rows = _events(spark, sf_dir).select((F.col("event_id") * 10).alias("appended_at_ns"), F.concat(F.lit("p-"), "user_id").alias("producer_id"), F.encode("props", "UTF-8").alias("event"), F.col("event_id").alias("trigger_arrival"), F.lit(False).alias("is_derived"), F.lit(0).alias("tie"))
    n, path = rows.count(), scratch(spark, "segments")
    numbered = log.with_offsets(rows).select("offset", "appended_at_ns", "producer_id", "event")
    numbered.repartitionById(8, F.expr(f"CAST(offset * 8 div {n} AS INT)")).sortWithinPartitions("offset").write.format("segments").mode("append").save(path)
    where, last = opened(path)[0], _files(path)[-1]
    with where.open_input_stream(last) as f:
        data = f.read()
    with where.open_output_stream(last) as f:
        f.write(data[:-7])
    return spark.read.format("segments").load(path).withColumn("event", F.decode("event", "UTF-8"))


_NAMES = _LOG_COLUMNS.replace('"', "").split(", ")


def _stored(spark: SparkSession, sf_dir: str) -> tuple[log.EventLog, list[DataFrame]]:
    """A log with the first 300 entries in it, and the rest for another append."""
    path = scratch(spark, "entries")
    _ingested(spark, sf_dir).log.withColumnRenamed("offset", "_place").write.parquet(path)
    rows = spark.read.parquet(path)
    kept = log.EventLog(spark, scratch(spark, "log"))
    kept.append(rows.where("_place < 300"), ["_place"], 1)
    return kept, [rows.where("_place >= 300")]


@query(f'{_LOG} SELECT {_LOG_COLUMNS} FROM log WHERE "offset" >= 100')
def log_tail(spark, sf_dir):
    """What is there, then what is appended while the first answer is read."""
    kept, more = _stored(spark, sf_dir)
    tail = kept.tail(100)
    first = next(tail)
    kept.append(more[0], ["_place"], 2)
    return first.unionByName(next(tail)).select(*_NAMES)


@query(f'{_LOG} SELECT {_LOG_COLUMNS} FROM log WHERE "offset" >= 250')
def log_subscription(spark, sf_dir):
    """The same as a stream that stops and goes on."""
    from .streaming.pipeline import subscribe

    kept, more = _stored(spark, sf_dir)
    folder, schema = scratch(spark, "subscription"), kept.read_range(0).schema

    def go_on() -> None:
        subscribe(spark, kept.path, schema, 250).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()

    go_on()
    kept.append(more[0], ["_place"], 2)
    go_on()
    return spark.read.schema(schema).parquet(f"{folder}/out").select(*_NAMES)


@query(f'{_LOG} SELECT {_LOG_COLUMNS.replace("producer_id, ", "")} FROM log WHERE "offset" >= 200 AND "offset" < 1200')
def log_stored_page(spark, sf_dir):
    """The page from a stored log: only the files that hold it are opened."""
    kept, more = _stored(spark, sf_dir)
    kept.append(more[0], ["_place"], 2)
    return kept.read_page(200, 5000)[0].select(*[c for c in _NAMES if c != "producer_id"])


def _rolled(spark: SparkSession, sf_dir: str) -> log.EventLog:
    """Seven appends by the clock, segments of three by their age."""
    rows = _events(spark, sf_dir).select("event_id", F.concat(F.lit("p-"), "user_id").alias("producer_id"))
    kept = log.EventLog(spark, scratch(spark, "rolled"), max_age_ns=20)
    for k in range(7):
        kept.append(rows.where(f"event_id % 7 = {k}"), ["event_id"], 10 * k)
    return kept


_ROLLED = "SELECT row_number() OVER (ORDER BY event_id % 7, event_id) - 1 AS o, event_id, event_id % 7 AS k, 'p-' || user_id AS producer_id FROM events"


@query(f"SELECT min(o) AS base_offset, max(o) AS last_offset, max(k) * 10 AS last_appended_at_ns, max(k) < 6 AS closed FROM ({_ROLLED}) GROUP BY k // 3")
def log_segments(spark, sf_dir):
    return _rolled(spark, sf_dir).segments().drop("byte_size")


@query(f'SELECT o AS "offset", k * 10 AS appended_at_ns, producer_id, event_id FROM ({_ROLLED}) WHERE o >= 450')
def log_evicted(spark, sf_dir):
    kept = _rolled(spark, sf_dir)
    kept.evict_below(450)
    return kept.read_range(kept.earliest_offset()).select("offset", "appended_at_ns", "producer_id", "event_id")


@query("SELECT requested, CASE WHEN requested < 450 THEN 450 END AS earliest, CASE WHEN requested < 450 THEN 410 ELSE 200 END AS status FROM (VALUES (0), (449), (450), (1000000000)) v(requested)")
def log_expired(spark, sf_dir):
    """What a reader is told: gone, there, or not there yet."""
    kept = _rolled(spark, sf_dir)
    kept.evict_below(450)
    out = []
    for requested in (0, 449, 450, 1_000_000_000):
        try:
            kept.read_range(requested, requested + 1)
            out.append((requested, None, 200))
        except log.RetentionExpired as e:
            out.append((requested, e.earliest, log.status_of(e)))
    return spark.createDataFrame(out, "requested int, earliest int, status int")


_X = "xor(xor(c >> 8, b), xor(c >> 8, b) >> 4)"


@query(f"""WITH t AS (SELECT event_id, user_id, event_type, props, list_transform(range(1, length(props) + 1), lambda i: CAST(ord(substr(props, i, 1)) AS BIGINT)) AS b FROM events)
SELECT event_id, CAST(list_reduce(list_prepend(CAST(65535 AS BIGINT), b), lambda c, b: xor(xor(xor((c << 8) & 65535, ({_X} << 12) & 65535), ({_X} << 5) & 65535), {_X}) & 65535) AS INTEGER) AS crc16,
xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda k, z: xor(k >> 1, 3988292384 * (k & 1)))), 4294967295) AS crc32,
CASE WHEN event_id % 3 <> 0 THEN md5(props) END AS hex, event_type IN ('view', 'click') AS equal, 'a=1,b=' || user_id || ',c=3' AS labels,
CASE event_type WHEN 'view' THEN 'Detection' WHEN 'error' THEN 'DetectorHealth' WHEN 'signup' THEN 'AdapterMetadata' END AS kind, true AS clock FROM t""")
def scalar_codecs(spark, sf_dir):
    t, kind = _events(spark, sf_dir), F.col("event_type")
    digits = F.when(F.col("event_id") % 3 == 0, F.upper(F.concat(F.md5("props"), F.lit("a")))).otherwise(F.md5("props"))
    labels = S.canonical_labels(F.create_map(F.lit("c"), F.lit("3"), F.lit("a"), F.lit("1"), F.lit("b"), F.col("user_id").cast("string")))
    body = lambda name: F.when(kind == name, F.lit(1))
    return t.select(
        "event_id", S.crc16_ccitt_false(F.encode("props", "UTF-8")).alias("crc16"), S.crc32(F.encode("props", "UTF-8")).alias("crc32"), F.lower(F.hex(S.hex_bytes(digits, 16))).alias("hex"),
        (S.bytes_equal(F.encode(kind, "UTF-8"), F.encode(F.lit("view"), "UTF-8")) | S.bytes_equal(kind, F.lit("click"))).alias("equal"),
        F.array_join(F.transform(labels, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("labels"),
        S.event_kind(Detection=body("view"), DetectorHealth=body("error"), AdapterMetadata=body("signup")).alias("kind"), (S.now_ns() > 1_700_000_000_000_000_000).alias("clock"),
    )


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in TABLE.items() if sql}
