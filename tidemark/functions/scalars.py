"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TRACE = "^([0-9a-f]{2})-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def traceparent_error(value: Column | str) -> Column:
    """The first thing wrong: Length, Structure, Hex, Version, TraceId or ParentId; null if it is well formed (or null)."""
    v = _col(value)
    part = lambda at, n: F.substring(v, at, n)
    dashes = (part(3, 1) == "-") & (part(36, 1) == "-") & (part(53, 1) == "-")
    return (
        F.when(v.isNull(), None)
        .when(F.octet_length(v) != 55, "Length")
        .when(~dashes, "Structure")
        .when(~v.rlike(_TRACE), "Hex")
        .when(part(1, 2) == "ff", "Version")
        .when(part(4, 32) == "0" * 32, "TraceId")
        .when(part(37, 16) == "0" * 16, "ParentId")
    )


def is_valid_traceparent(value: Column | str) -> Column:
    v = _col(value)
    return v.isNotNull() & traceparent_error(v).isNull()


def parse_traceparent(value: Column | str) -> Column:
    """Struct (version, trace_id, parent_id, flags), null if malformed."""
    v = _col(value)
    names = ("version", "trace_id", "parent_id", "flags")
    return F.when(is_valid_traceparent(v), F.struct(*[F.regexp_extract(v, _TRACE, k + 1).alias(n) for k, n in enumerate(names)]))


def format_traceparent(trace_id: Column | str, parent_id: Column | str, flags: Column | str) -> Column:
    """From hexadecimal ids of any case and length; null if an id is zero, null or too long, or the flags aren't a byte."""
    t, p, f = (F.lower(_col(x)) for x in (trace_id, parent_id, flags))
    good = t.rlike("^[0-9a-f]{1,32}$") & p.rlike("^[0-9a-f]{1,16}$") & f.rlike("^[0-9a-f]{1,2}$")
    return F.when(good & ~t.rlike("^0+$") & ~p.rlike("^0+$"), F.concat_ws("-", F.lit("00"), F.lpad(t, 32, "0"), F.lpad(p, 16, "0"), F.lpad(f, 2, "0")))


def hex_bytes(value: Column | str, n: int) -> Column:
    """The bytes of exactly 2n lower-case hexadecimal digits, else null."""
    v = _col(value)
    return F.when(v.rlike(f"^[0-9a-f]{{{2 * n}}}$"), F.unhex(v))


def parse_bearer_token(header: Column | str) -> Column:
    """The token after a scheme of any case and spaces or tabs; null for other schemes, without separator, or empty."""
    token = F.regexp_extract(_col(header), "(?is)^[ \\t]*bearer[ \\t]+(.*?)[ \\t]*$", 1)
    return F.when(token != "", token)


def bytes_equal(a: Column | str, b: Column | str) -> Column:
    return _col(a) == _col(b)


def saturating_sub(a: Column | str, b: Column | str) -> Column:
    """a - b, 0 at least; arguments aren't negative, so the difference can't overflow."""
    return F.greatest(_col(a) - _col(b), F.lit(0).cast("long"))


def saturating_add(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_add(a, b), F.lit(2**63 - 1)))


def checked_next(offset: Column | str) -> Column:
    """offset + 1, null at the largest."""
    return F.try_add(_col(offset), F.lit(1).cast("long"))


def now_ns() -> Column:
    return F.unix_micros(F.current_timestamp()) * 1000


def crc32(value: Column | str) -> Column:
    return F.crc32(_col(value))


def crc16_ccitt_false(value: Column | str) -> Column:
    """Polynomial 0x1021, start 0xFFFF, no reflection, no final xor; four table-free shifts a byte."""
    digits = F.hex(_col(value))
    places = F.sequence(F.lit(0), F.octet_length(_col(value)) - 1)
    octets = F.when(F.octet_length(_col(value)) == 0, F.array().cast("array<int>")).otherwise(F.transform(places, lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))

    def step(crc: Column, octet: Column) -> Column:
        x = F.shiftright(crc, 8).bitwiseXOR(octet)
        x = x.bitwiseXOR(F.shiftright(x, 4))
        return F.shiftleft(crc, 8).bitwiseXOR(F.shiftleft(x, 12)).bitwiseXOR(F.shiftleft(x, 5)).bitwiseXOR(x).bitwiseAND(F.lit(0xFFFF))

    return F.aggregate(octets, F.lit(0xFFFF), step)


def canonical_labels(labels: Column | str) -> Column:
    """The entries of a map by key."""
    return F.array_sort(F.map_entries(_col(labels)))


def escape_label_value(value: Column | str) -> Column:
    out = F.replace(_col(value), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    out = F.replace(out, F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit("\r"), F.lit("\\r"))


def overflow_metric_name(name: Column | str) -> Column:
    n = _col(name)
    return F.when(n.endswith("_total"), F.concat(F.expr("''"), F.regexp_replace(n, "_total$", "_overflow_total"))).otherwise(F.concat(n, F.lit("_overflow")))


def event_kind(**bodies: Column) -> Column:
    """The label of the first payload that isn't null."""
    out = None
    for label, body in bodies.items():
        out = F.when(body.isNotNull(), label) if out is None else out.when(body.isNotNull(), label)
    return out
