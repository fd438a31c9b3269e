"""The stream gives the batch's log, however its input is cut, and goes on where it stopped."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.log import EventLog
from tidemark.queries import _ingested, streamed
from tidemark.sources.events import WINDOW_NS, detections
from tidemark.streaming.pipeline import Crossings, run_log, subscribe, use_rocksdb

SF = "/root/testdata/sf0.001"
COLUMNS = ["offset", "trigger_arrival", "is_derived", "producer_id", "kind", "detection_id", "crossing_id", "subject_id", "at_ns"]


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).orderBy("offset").collect()]


@pytest.fixture(scope="module")
def batch(spark):
    return rows(_ingested(spark, SF).log)


@pytest.mark.parametrize("files", [1, 4])
def test_same_log(spark, tmp_path, batch, files):
    assert rows(streamed(spark, SF, f"file://{tmp_path}", files)) == batch


def test_restart_and_tail(spark, tmp_path, batch):
    use_rocksdb(spark)
    d = detections(spark, SF)
    where = f"file://{tmp_path}"
    log = EventLog(spark, f"{where}/log")
    for part in (d.where("arrival < 700"), d.where("arrival >= 700")):
        part.coalesce(1).write.mode("append").parquet(f"{where}/in")
        source = spark.readStream.schema(d.schema).parquet(f"{where}/in")
        run_log(source, log, f"{where}/checkpoint", lambda b: b, WINDOW_NS).awaitTermination()
    assert rows(log.read_range(0)) == batch
    stored = log.read_range(0)
    tail = subscribe(spark, f"{where}/log", stored.schema, 900).writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    tail.awaitTermination()
    assert [r.offset for r in spark.table("tail").orderBy("offset").collect()] == list(range(900, len(batch)))
    assert stored.select(F.max("offset")).first()[0] == len(batch) - 1


def test_subscription_ends_when_its_offset_is_evicted(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}/log")
    rows = spark.createDataFrame([(f"p{k}", k) for k in range(10)], "producer_id string, x bigint")
    log.append(rows, ["x"], 1)
    schema = log.read_range(0).schema

    def run(start, name):
        query = subscribe(spark, f"file://{tmp_path}/log", schema, start).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/{name}-c").trigger(availableNow=True).start(f"file://{tmp_path}/{name}")
        query.awaitTermination()
        return sorted(r.offset for r in spark.read.schema(schema).parquet(f"file://{tmp_path}/{name}").collect())

    assert run(4, "a") == [4, 5, 6, 7, 8, 9] and run(4, "a") == [4, 5, 6, 7, 8, 9]
    spark.createDataFrame([("lost", 1)], "producer_id string, x bigint").selectExpr("99L AS offset", "1L AS appended_at_ns", "*").write.parquet(f"file://{tmp_path}/log/data/segment_base=0/append=dead")
    log.append(rows, ["x"], 2)
    log.evict_below(12)
    with pytest.raises(Exception, match="offset 10 is no longer kept; earliest is 12"):
        run(4, "a")
    assert run(12, "b") == list(range(12, 20))


class State(dict):
    """A map in place of a handle's."""

    getMapState = lambda self, *_: self
    getValue = dict.get
    updateValue = dict.__setitem__


def test_a_call_groups_many_keys():
    """Points, subjects and rows without subject share calls; open groups go on in the next call, whatever is untouched stays."""
    names = ["timing_point_id", "subject_id", "arrival", "producer_id", "detection_id", "detected_at_ns", "detected_at_uncertainty_ns", "timebase_id", "timestamping_method", "source_attestation", "rssi"]

    def frame(*some):
        return pd.DataFrame([(p, s, a, "prod", f"d{a}", t, u, "tb", "m", "sa", r) for p, s, a, t, u, r in some], columns=names)

    processor, state = Crossings(10), State()
    processor.init(state)

    def call(*frames):
        out = pd.concat(list(processor.handleInputRows((0,), iter(frames), None)))
        done = out[out.is_derived]
        return sorted((r.timing_point_id, r.subject_id, r.trigger_arrival, r.at_ns, r.uncertainty_ns, list(r.detection_ids)) for r in done.itertuples()), sorted(out[~out.is_derived].trigger_arrival)

    made, passed = call(frame(("a", "x", 5, 4, 3, None), ("a", None, 4, 7, None, None)), frame(("a", "x", 1, 0, None, -5), ("b", "x", 2, 0, None, None), ("b", "y", 3, 1, None, None)))
    assert made == [("a", None, 4, 7, None, ["d4"])] and passed == [1, 2, 3, 4, 5] and len(state) == 3
    made, passed = call(frame(("a", "x", 8, 50, None, None), ("b", "y", 7, 9, None, None), ("b", "y", 6, 8, None, None)))
    assert made == [("a", "x", 8, 0, 4, ["d1", "d5"])] and passed == [6, 7, 8]
    made, _ = call(frame(("b", "x", 10, 11, None, None), ("b", "y", 11, 99, None, None)))
    assert made == [("b", "x", 10, 0, None, ["d2"]), ("b", "y", 11, 1, 8, ["d3", "d6", "d7"])]
