from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import log as L
from tidemark.operators.crossings import crossings
from tidemark.plans.service import ingest
from test_crossings import SCHEMA, S, row


def fill(log, spark, n, at=1, **kw):
    return log.append(spark.createDataFrame([("p", k) for k in range(n)], "producer_id string, k bigint"), ["k"], at, **kw)


@pytest.fixture
def folder(tmp_path):
    return "file://" + str(tmp_path / "log")


def test_append_and_read(spark, folder):
    log = L.EventLog(spark, folder)
    assert (log.earliest_offset(), log.latest_offset(), log.next_offset()) == (None, None, 0)
    assert log.read_range(0) is None
    assert fill(log, spark, 3) == 2 and fill(log, spark, 4, 2) == 6
    assert (log.earliest_offset(), log.latest_offset()) == (0, 6)
    assert [r.offset for r in log.read_range(2, 5).collect()] == [2, 3, 4]
    assert [r.offset for r in log.read_range(5).collect()] == [5, 6]
    assert log.read_range(7) is None and log.read_range(3, 3) is None
    again = L.EventLog(spark, folder)
    assert fill(again, spark, 1, 3) == 7
    rows, latest = again.read_page(6, 5000)
    assert [r.offset for r in rows.collect()] == [6, 7] and latest == 7 and "producer_id" not in rows.columns


def test_bad_appends(spark, folder):
    log = L.EventLog(spark, folder)
    for rows in ([], [("", 1)], [("x" * 257, 1)], [(None, 1)]):
        with pytest.raises(L.InvalidInput):
            log.append(spark.createDataFrame(rows, "producer_id string, k bigint"), ["k"], 1)
    assert log.next_offset() == 0


def test_replayed_batch(spark, folder):
    log = L.EventLog(spark, folder)
    assert fill(log, spark, 2, batch_id=0) == 1
    assert fill(log, spark, 2, batch_id=0) is None
    assert fill(log, spark, 2, batch_id=1) == 3 and log.next_offset() == 4


def test_roll_and_retention_by_age(spark, folder):
    log = L.EventLog(spark, folder, max_bytes=1, retain_age_ns=10)
    for at in (1, 2, 3):
        fill(log, spark, 5, at)
    assert log.segments().count() == 3 and log.earliest_offset() == 0
    fill(log, spark, 5, 13)
    assert log.earliest_offset() == 10  # 13 - 10: appended before 3 goes, at 3 stays
    with pytest.raises(L.RetentionExpired) as e:
        log.read_range(2)
    assert (e.value.requested, e.value.earliest) == (2, 10) and L.status_of(e.value) == 410
    assert [r.offset for r in log.read_range(10, 12).collect()] == [10, 11]


def test_fully_evicted(spark, folder):
    log = L.EventLog(spark, folder, max_bytes=1, retain_bytes=0)
    fill(log, spark, 5)
    assert (log.earliest_offset(), log.latest_offset(), log.next_offset()) == (None, None, 5)
    with pytest.raises(L.RetentionExpired) as e:
        log.read_range(4)
    assert e.value.earliest is None
    assert log.read_range(5) is None
    assert fill(L.EventLog(spark, folder), spark, 1) == 5  # a log that lost everything isn't a new one


def test_evict(spark, folder):
    log = L.EventLog(spark, folder)
    fill(log, spark, 10)
    log.evict_below(5)
    with pytest.raises(L.RetentionExpired) as e:
        log.read_range(2, 8)
    assert e.value.earliest == 5 and [r.offset for r in log.read_range(5, 8).collect()] == [5, 6, 7]
    log.evict_below(99)
    assert (log.earliest_offset(), log.latest_offset(), log.next_offset()) == (None, None, 10)
    assert fill(log, spark, 1) == 10 and log.earliest_offset() == 10


def test_tail(spark, folder):
    log = L.EventLog(spark, folder)
    fill(log, spark, 3)
    tail = log.tail(1)
    assert [r.offset for r in next(tail).collect()] == [1, 2]
    assert next(tail).collect() == []
    fill(log, spark, 2)
    assert [r.offset for r in next(tail).collect()] == [3, 4]


def test_tail_loses_nothing_that_is_appended_while_it_is_read(spark, folder):
    log = L.EventLog(spark, folder)
    fill(log, spark, 3)
    whole = log._range
    log._range = lambda *args: (whole(*args), fill(L.EventLog(spark, folder), spark, 2))[0]  # an append right after the manifest was read
    tail = log.tail(0)
    assert [r.offset for r in next(tail).collect()] == [0, 1, 2]
    assert [r.offset for r in next(tail).collect()] == [3, 4]


def test_pages():
    assert L.page_range() == (0, 100) and L.page_range(5, 5000) == (5, 1005) and L.page_range(2**63 - 5, 100) == (2**63 - 5, 2**63 - 1)


def test_rolls():
    assert list(L.rolled([(0, 40, 0), (2, 30, 1), (3, 10, 2), (9, 5, 100)], 64, 50)) == [(0, 0), (2, 0), (3, 3), (9, 3)]


def manifest(spark, rows):
    return spark.createDataFrame(rows, "base_offset bigint, last_offset bigint, last_appended_at_ns bigint, byte_size bigint, closed boolean")


def kept(df):
    return [r.base_offset for r in df.where("keep").orderBy("base_offset").collect()]


def test_retention_plan(spark):
    m = manifest(spark, [(0, 4, 10, 100, True), (5, 9, 20, 100, True), (10, 14, 5, 100, True), (15, 19, 40, 100, False)])
    assert kept(L.retained(m)) == [0, 5, 10, 15]
    assert kept(L.retained(m, 50, 30)) == [5, 10, 15]  # an old segment behind a young one stays
    assert kept(L.retained(m, max_bytes=250)) == [10, 15] and kept(L.retained(m, max_bytes=0)) == [15]
    assert kept(L.retained(m, 50, 30, 100)) == [15]


@pytest.mark.parametrize("stretch", [1, 3, 1 << 20])
def test_interleaved_offsets(spark, stretch):
    rows = [row(k, "a", "car", 0.4 * k) for k in range(5)] + [row(k, "a", None, 2.0) for k in (5, 6)]
    made = ingest(spark.createDataFrame(rows, SCHEMA), 2 * S)
    got = L.log_entries(made.accepted, crossings(made.accepted, 2 * S), stretch=stretch).orderBy("offset").collect()
    assert [r.offset for r in got] == list(range(9))
    assert [r.kind for r in got] == ["Detection"] * 6 + ["Crossing", "Detection", "Crossing"]


def test_named_detections_alone_make_no_crossing(spark):
    made = ingest(spark.createDataFrame([row(k, "a", "car", 0.4 * k) for k in range(5)], SCHEMA), 2 * S)
    assert made.log.count() == 5 and L.bounds(made.log).first().latest_offset == 4


def test_long_append_is_numbered_by_many_tasks(spark, folder, monkeypatch):
    """What an append holds is not one task's to sort; offsets are dense and in order, of descending and repeated keys too."""
    monkeypatch.setattr(L, "SORTED_ROWS", 100)
    log = L.EventLog(spark, folder)
    fill(log, spark, 3)
    rows = spark.range(0, 1000, 1, 5).selectExpr("'p' AS producer_id", "CAST(id % 50 AS BIGINT) AS g", "CAST(id AS BIGINT) AS k")
    plans = []
    placed = log._placed
    log._placed = lambda *args: plans.append(placed(*args)) or plans[-1]
    assert log.append(rows, [F.desc("g"), "k"], 2) == 1002
    got = [(r.offset, r.g, r.k) for r in log.read_range(3).collect()]
    assert got == [(3 + n, g, k) for n, (g, k) in enumerate(sorted(((k % 50, k) for k in range(1000)), key=lambda x: (-x[0], x[1])))]
    plan = plans[0]._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert not list(Path(folder.removeprefix("file://")).glob("_staged*"))
