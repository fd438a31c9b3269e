import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.functions import scalars as S

GOOD = "00-0af7651916cd43dd8448eb211c80319c-b7ad6b7169203331-01"


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "error"),
    [(GOOD, None), ("cc" + GOOD[2:], None), (GOOD[:-1], "Length"), (GOOD + "0", "Length"), ("", "Length"), (GOOD.replace("-", "_"), "Structure"), (GOOD[:10] + "-" + GOOD[11:], "Hex"), (GOOD.upper(), "Hex"), (GOOD[:-1] + "g", "Hex"), ("ff" + GOOD[2:], "Version"), ("00-" + "0" * 32 + GOOD[35:], "TraceId"), (GOOD[:36] + "0" * 16 + "-01", "ParentId"), (GOOD[:-2] + "é", "Structure" if False else "Hex")],
)
def test_traceparent(spark, value, error):
    assert one(spark, S.traceparent_error("v"), v=value) == error
    assert one(spark, S.is_valid_traceparent("v"), v=value) is (error is None)
    parsed = one(spark, S.parse_traceparent("v"), v=value)
    assert (parsed is None) == (error is not None)
    if error is None:
        assert "-".join(parsed) == value


def test_traceparent_format(spark):
    f = lambda a, b, c: one(spark, S.format_traceparent(F.lit(a), F.lit(b), F.lit(c)))
    assert f("0af7651916cd43dd8448eb211c80319c", "b7ad6b7169203331", "1") == GOOD
    assert f("0", "1", "1") is None and f("1", "000", "1") is None and f("1", "1", "1ff") is None and f("xyz", "1", "1") is None


@pytest.mark.parametrize(
    ("header", "token"), [("Bearer abc", "abc"), ("bearer abc", "abc"), ("BEARER\tabc", "abc"), ("  Bearer \t  abc  ", "abc"), ("Basic abc", None), ("Bearerabc", None), ("Bearer", None), ("Bearer  ", None), ("", None), ("Bearer a b", "a b")]
)
def test_bearer(spark, header, token):
    assert one(spark, S.parse_bearer_token("h"), h=header) == token


@pytest.mark.parametrize("data", [b"", b"123456789", b"\x00", bytes(range(256)), b"\xff" * 300])
def test_checksums(spark, data):
    df = spark.createDataFrame([(bytearray(data),)], "b binary")
    got = df.select(S.crc16_ccitt_false("b"), S.crc32("b")).first()
    assert tuple(got) == (codec.crc16(data), zlib.crc32(data))
    if data == b"123456789":
        assert got[0] == 0x29B1


def test_small_ones(spark):
    assert one(spark, S.saturating_sub(F.lit(3), F.lit(5))) == 0
    assert one(spark, S.saturating_add(F.lit(2**63 - 1), F.lit(1))) == 2**63 - 1
    assert one(spark, S.checked_next(F.lit(2**63 - 1))) is None and one(spark, S.checked_next(F.lit(4))) == 5
    assert one(spark, S.escape_label_value("v"), v='a\\"\n\r') == 'a' + '\\' * 2 + '\\"' + '\\n' + '\\r'
    assert one(spark, S.overflow_metric_name("v"), v="x_total") == "x_overflow_total" and one(spark, S.overflow_metric_name("v"), v="x") == "x_overflow"
    assert [tuple(e) for e in one(spark, S.canonical_labels(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))))] == [("a", "2"), ("b", "1")]
    assert bytes(one(spark, S.hex_bytes("v", 2), v="0aff")) == b"\x0a\xff" and one(spark, S.hex_bytes("v", 2), v="0AFF") is None
    assert one(spark, S.bytes_equal(F.lit("a"), F.lit("a"))) is True and one(spark, S.now_ns()) > 1_700_000_000_000_000_000
    assert one(spark, S.event_kind(Detection=F.lit(None), Crossing=F.lit(1))) == "Crossing"
