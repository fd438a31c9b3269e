"""Handshake, authorisation and dispatch as CASE ladders; what is refused stays as rows with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_valid_traceparent
from ..schema import PROTOCOL_VERSION

SERVER_ID = "server"


def authorised(token: Column, allowed: list[str]) -> Column:
    """Whether a token may connect; an empty list lets everyone in."""
    if not allowed:
        return F.lit(True)
    return F.coalesce(token.isin(allowed), F.lit(False))


def handshakes(connects: DataFrame, allowed: list[str], server_version: int = PROTOCOL_VERSION) -> DataFrame:
    """Adds ``outcome`` (Accepted, Rejected, Error), ``reason``, ``reply_source_id``, ``negotiated_version``.

    Rows have message_type, has_payload, payload_ok, protocol_version_min and _max, auth_token, correlation_id; the
    version is checked before the token, and the correlation id goes back with the reply.
    """
    reason = (
        F.when(F.col("message_type") != "Connect", "UnexpectedMessageType")
        .when(~F.col("has_payload"), "MissingConnectPayload")
        .when(~F.col("payload_ok"), "DecodeFailed")
        .when(~F.lit(server_version).between(F.col("protocol_version_min"), F.col("protocol_version_max")), "VersionNotSupported")
        .when(~authorised(F.col("auth_token"), allowed), "Unauthorized")
    )
    outcome = F.when(reason.isNull(), "Accepted").when(reason.isin("VersionNotSupported", "Unauthorized"), "Rejected").otherwise("Error")
    replied = outcome != "Error"
    return connects.select(
        "*", outcome.alias("outcome"), reason.alias("reason"), F.when(replied, SERVER_ID).alias("reply_source_id"), F.when(replied, F.col("correlation_id")).alias("reply_correlation_id"), F.when(outcome == "Accepted", server_version).alias("negotiated_version")
    )


def dispatched(envelopes: DataFrame, negotiated: int = PROTOCOL_VERSION) -> DataFrame:
    """Adds ``action`` (Event, Heartbeat, Disconnect, Error), ``error``, and clears a malformed traceparent.

    Rows have session, arrival, registered_id, protocol_version, source_id, message_type, has_payload, payload_ok,
    traceparent. Version, then source, then what the type asks of its payload.
    """
    kind, has = F.col("message_type"), F.col("has_payload")
    error = (
        F.when(F.col("protocol_version") != negotiated, "VersionMismatch")
        .when(F.col("source_id") != F.col("registered_id"), "SourceMismatch")
        .when((kind == "Event") & ~has, "MissingEventPayload")
        .when((kind == "Heartbeat") & ~has, "MissingHeartbeatPayload")
        .when(kind.isin("Event", "Heartbeat") & ~F.col("payload_ok"), "DecodeFailed")
        .when((kind == "Disconnect") & has, "UnexpectedDisconnectPayload")
        .when(~kind.isin("Event", "Heartbeat", "Disconnect"), "UnexpectedMessageType")
    )
    trace = F.when(is_valid_traceparent("traceparent"), F.col("traceparent"))
    out = envelopes.withColumns({"error": error, "action": F.when(error.isNull(), kind).otherwise("Error")})
    return out.withColumn("traceparent", trace)


def until_end(actions: DataFrame) -> DataFrame:
    """A session ends at its first error or Disconnect; later rows go, the last one stays."""
    ended = F.col("action").isin("Error", "Disconnect")
    w = Window.partitionBy("session").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(ended.cast("int")).over(w), F.lit(0))
    return actions.withColumn("_ended", before).where("_ended = 0").drop("_ended")


def surfaced(actions: DataFrame) -> DataFrame:
    """Events only: heartbeats, disconnects and errors aren't data."""
    return actions.where("action = 'Event'")


def quarantined(actions: DataFrame) -> DataFrame:
    return actions.where("action = 'Error'")


def not_metadata_first(events: DataFrame) -> DataFrame:
    """First events of a source that aren't its metadata; rows have source_id, arrival, kind."""
    w = Window.partitionBy("source_id").orderBy("arrival")
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1 AND kind <> 'AdapterMetadata'").drop("_n")
