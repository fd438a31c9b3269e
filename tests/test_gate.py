import random

import pytest
import replay

from tidemark.operators import gate

SCHEMA = "producer_id string, detector_id string, sequence_number bigint, arrival bigint"


def decide(spark, rows, seed=None, stretch=gate.STRETCH):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA).repartition(3)
    s = None if seed is None else spark.createDataFrame([(*k, v) for k, v in seed.items()], "producer_id string, detector_id string, high_water bigint")
    out = gate.gate_decisions(df, s, stretch).orderBy("arrival").collect()
    return [(r.decision, r.expected, r.missing) for r in out]


@pytest.mark.parametrize(
    ("numbers", "decisions"),
    [([5], ["Accept"]), ([5, 6], ["Accept", "Advance"]), ([5, 5], ["Accept", "Duplicate"]), ([10, 7], ["Accept", "Duplicate"]), ([5, 9], ["Accept", "Gap"]), ([0, 1], ["Accept", "Advance"]), ([1, 2, 3, 3, 4], ["Accept", "Advance", "Advance", "Duplicate", "Advance"]), ([1, 3, 2, 4], ["Accept", "Gap", "Duplicate", "Advance"])],
)
def test_single_key(spark, numbers, decisions):
    assert [d for d, _, _ in decide(spark, [("p", "loop-1", n) for n in numbers])] == decisions


def test_keys_are_independent(spark):
    assert [d for d, _, _ in decide(spark, [("p", "loop-1", 5), ("p", "loop-2", 1), ("p", "loop-2", 2)])] == ["Accept", "Accept", "Advance"]
    assert [d for d, _, _ in decide(spark, [("a", "loop-1", 100), ("b", "loop-1", 5)])] == ["Accept", "Accept"]


def test_gap_says_what_is_missing(spark):
    assert decide(spark, [("p", "d", 5), ("p", "d", 9)])[1] == ("Gap", 6, 3)


def test_seed(spark):
    seed = {("p", "loop-1"): 3, ("q", "loop-2"): 5}
    assert [d for d, _, _ in decide(spark, [("p", "loop-1", 3), ("p", "loop-1", 4), ("q", "loop-2", 5)], seed)] == ["Duplicate", "Advance", "Duplicate"]


@pytest.mark.parametrize("stretch", [1, 7, 50, 1 << 20])
def test_any_stretch_gives_the_same(spark, stretch):
    rng = random.Random(stretch)
    rows, n = [], {}
    for _ in range(400):
        key = rng.choice([("p", "a"), ("p", "b"), ("q", "a"), (None, "a")])
        n[key] = max(0, n.get(key, 10) + rng.choice([1, 1, 1, 2, 3, 0, -2]))
        rows.append((*key, n[key]))
    seed = {("p", "a"): 20}
    assert decide(spark, rows, seed, stretch) == replay.gate(rows, seed)
    assert decide(spark, rows, None, stretch) == replay.gate(rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert gate.gate_decisions(df).collect() == [] and gate.high_water(df).collect() == []
