"""Every core query against its DuckDB SQL, and the counts that the derivation is known to have."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries as Q
from tidemark.operators.gate import accepted, gate_decisions
from tidemark.sources.events import detections

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.TABLE))
def test_oracle(spark, duck, name):
    found = duck.execute(Q.TABLE[name][1])
    names = [d[0] for d in found.description]
    want = sorted(map(repr, found.fetchall()))
    df = Q.TABLE[name][0](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want and want


def test_known_counts(spark):
    decided = gate_decisions(detections(spark, MIDDLE))
    assert decided.count() == 10589 and accepted(decided).count() == 10000
    made = Q._ingested(spark, MIDDLE, True).crossings
    assert made.where("subject_id IS NULL").count() == 2014
    assert made.where("subject_id IS NOT NULL").count() == 3534 and made.where("subject_id IS NOT NULL AND NOT is_open").count() == 2934


def test_contract(spark):
    assert entry.entry(spark).count() == 494
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_views(spark):
    from tidemark.plans.views import register

    names = register(spark, detections(spark, SMALL), Q.WINDOW_NS)
    assert {"gate", "crossings", "log"} <= set(names)
    assert spark.sql("SELECT count(*) AS n FROM log WHERE kind = 'Crossing'").first().n == spark.table("crossings").count() == 494
    for name in names:
        spark.catalog.dropTempView(name)
