import random

import pytest
import replay

from tidemark.operators import crossings as C
from tidemark.schema import DETECTION

S = 1_000_000_000
SCHEMA = DETECTION + ", producer_id string, arrival bigint"


def row(k, point, subject, t, rssi=None, u=None, sensor=None, detector="loop-1", producer="p"):
    kind = sensor or ("BeamBreak" if rssi is None else "LoopTransponder")
    return (f"d{k}", detector, point, subject, int(t * S), u, None, "HardwareEventCapture", "gps-1", "RuntimeDiscovered", k, (kind, rssi, None, None), producer, k)


def make(spark, rows, window=S, emit_open=True, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return C.crossings(df, window, emit_open).orderBy("first_arrival").collect()


def ids(rows):
    return [r.detection_ids for r in rows]


def test_merge_and_split(spark):
    assert ids(make(spark, [row(1, "a", "s1", 1.0), row(2, "a", "s1", 1.5)])) == [["d1", "d2"]]
    out = make(spark, [row(1, "a", "s1", 1.0), row(2, "a", "s1", 3.0)])
    assert ids(out) == [["d1"], ["d2"]]
    assert [(r.trigger_arrival, r.is_open) for r in out] == [(2, False), (None, True)]
    assert ids(make(spark, [row(1, "a", "s1", 1.0), row(2, "a", "s1", 3.0)], emit_open=False)) == [["d1"]]


def test_keys(spark):
    assert len(make(spark, [row(1, "a", "s1", 1.0), row(2, "a", "s2", 1.0)])) == 2
    assert len(make(spark, [row(1, "a", "s1", 1.0), row(2, "b", "s1", 1.0)])) == 2
    assert ids(make(spark, [row(1, "a", "s1", 1.0, detector="x", producer="p"), row(2, "a", "s1", 1.1, detector="y", producer="q")])) == [["d1", "d2"]]


def test_anonymous(spark):
    out = make(spark, [row(1, "a", None, 1.0), row(2, "a", None, 1.0)], emit_open=False)
    assert ids(out) == [["d1"], ["d2"]] and [r.trigger_arrival for r in out] == [1, 2]


def test_peaks(spark):
    at = lambda rows: [r.crossed_at_ns / S for r in make(spark, rows)]
    assert at([row(1, "a", "s", 1.0, -80), row(2, "a", "s", 1.1, -50)]) == [1.1]
    assert at([row(1, "a", "s", 1.0), row(2, "a", "s", 1.1)]) == [1.0]
    assert at([row(1, "a", "s", 1.0, -50), row(2, "a", "s", 1.1, -50)]) == [1.1]  # the last of equals
    assert at([row(1, "a", "s", 1.0), row(2, "a", "s", 1.1, -90)]) == [1.1]
    assert at([row(1, "a", "s", 5.0), row(2, "a", "s", 3.0)]) == [3.0]
    assert at([row(1, "a", "s", 1.0, -60), row(2, "a", "s", 1.1, -20, sensor="Manual")]) == [1.0]  # only loops have a signal


def test_first_of_equal_times_wins(spark):
    out = make(spark, [row(1, "a", "s", 1.0, u=7), row(2, "a", "s", 1.0, u=9)])
    assert out[0].crossed_at_uncertainty_ns == 7


def test_uncertainty(spark):
    u = lambda rows: make(spark, rows)[0].crossed_at_uncertainty_ns
    assert u([row(1, "a", "s", 1.0, -60, 10_000_000), row(2, "a", "s", 1.5, -50)]) == S // 2
    assert u([row(1, "a", "s", 1.0, -60, 900_000_000), row(2, "a", "s", 1.5, -70)]) == 900_000_000
    assert u([row(1, "a", "s", 1.0)]) is None
    assert u([row(1, "a", "s", 5.0), row(2, "a", "s", 3.0)]) == 2 * S


def test_anchored_not_sliding(spark):
    assert ids(make(spark, [row(1, "a", "s", 0), row(2, "a", "s", 0.9), row(3, "a", "s", 1.8)])) == [["d1", "d2"], ["d3"]]
    r = list(row(3, "a", "s", 1.0))
    r[4] += 1
    assert ids(make(spark, [row(1, "a", "s", 0), row(2, "a", "s", 1.0), tuple(r)])) == [["d1", "d2"], ["d3"]]


def test_ids_are_stable(spark):
    rows = [row(1, "a", "s", 1.0), row(2, "a", "s", 9.0), row(3, "a", None, 1.0)]
    assert [r.crossing_id for r in make(spark, rows)] == [r.crossing_id for r in make(spark, rows, parts=1)]


@pytest.mark.parametrize("batch", [3, 64, 10_000])
def test_random_against_replay(spark, batch):
    rng = random.Random(batch)
    rows = []
    for k in range(700):
        rssi = rng.choice([None, -90, -50, -50, -20])
        rows.append(row(k, rng.choice("ab"), rng.choice(["s1", "s2", "s3", None]), k * 0.05 + rng.choice([0, 0, 0.3, -1.0]), rssi, rng.choice([None, 0, 5_000_000])))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = make(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = [{"id": r[0], "point": r[2], "subject": r[3], "t": r[4], "u": r[5], "rssi": r[11][1], "arrival": r[13]} for r in rows]
    want = replay.crossings(plain, S, flush=True)
    key = lambda x: x[0]
    have = sorted(((tuple(r.detection_ids), r.timing_point_id, r.subject_id, r.crossed_at_ns, r.crossed_at_uncertainty_ns, r.trigger_arrival) for r in got), key=key)
    assert have == sorted(((tuple(c["ids"]), c["point"], c["subject"], c["at"], c["u"], a) for c, a in want), key=key)


def test_empty(spark):
    assert make(spark, []) == []


def test_long_groups_are_joined_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tidemark.operators import crossings as C

    rng, rows = np.random.default_rng(3), []
    for key in range(3):  # a key's times go up, more or less; the second is one group
        at = np.cumsum(rng.integers(0, 400, 3000)) + rng.integers(-300, 300, 3000) if key != 1 else rng.integers(0, 900, 3000)
        rows += [("p", f"s{key}", k, "x", f"d{key}-{k}", int(t), None, "tb", "m", "a", None) for k, t in enumerate(at.tolist())]
    names = C._COLUMNS
    kinds = dict.fromkeys(names, pa.string()) | {"arrival": pa.int64(), "detected_at_ns": pa.int64(), "detected_at_uncertainty_ns": pa.int64(), "rssi": pa.int32()}
    table = pa.table({n: pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)})
    want, anchor = [], {}
    for r in rows:
        if r[1] not in anchor or r[5] - anchor[r[1]] > 1000:
            anchor[r[1]] = r[5]
            want.append([])
        want[-1].append(r[4])
    joins = []
    monkeypatch.setattr(C, "_one", lambda b, whole=C._one: (joins.append(len(b)), whole(b))[1])
    for size in (7, 50, 9000):
        got = [ids for _, g in C.grouped(iter(table.to_batches(max_chunksize=size)), 1000) for ids in g.column("detection_ids").to_pylist()]
        assert got == want
    assert max(joins) > 50
