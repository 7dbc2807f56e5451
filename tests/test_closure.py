"""A closure that follows random changes equals one built anew."""

import random

import pytest

from codestrata.operators.closure import Closure
from tests.test_walks import depths, frame, graph


def seeds(spark, names):
    return spark.createDataFrame([(s,) for s in [*names, None, names[0]]], "seed string")


def found(closure):
    rows = [tuple(r) for r in closure.dependents().collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def want(edges, names):
    return {(s, x) for s in names for x in depths(edges, s)}


def test_random_changes(spark, tmp_path):
    rng, names = random.Random(3), [f"n{i}" for i in range(70)]
    edges = set(graph(70, 90, 4))
    c = Closure.build(frame(spark, sorted(edges)), seeds(spark, names), f"file://{tmp_path}/c", buckets=2)
    assert found(c) == want(edges, names)
    for _ in range(2):
        removed, added = set(rng.sample(sorted(edges), 8)), set(graph(70, 6, rng.random()))
        both = next(iter(removed))
        edges = (edges - removed) | added | {both}
        c = c.update(frame(spark, sorted(added | {both}) * 2), frame(spark, sorted(removed) + [("n1", "nowhere")]))
        assert found(c) == want(edges, names)
    assert {r.seed: r.n for r in c.counts().collect()} == {s: n for s in names if (n := len(depths(edges, s)))}
    assert found(Closure(spark, f"file://{tmp_path}/c", 1)) == want(set(graph(70, 90, 4)), names)


def test_a_cycle_that_is_cut_off_does_not_hold_itself_up(spark, tmp_path):
    edges = {("a", "b"), ("b", "c"), ("c", "a"), ("c", "goal"), ("x", "a"), ("goal", "up")}
    c = Closure.build(frame(spark, sorted(edges)), seeds(spark, ["goal", "a"]), f"file://{tmp_path}/c", buckets=2)
    assert found(c) == want(edges, ["goal", "a"])
    edges -= {("c", "goal")}
    c = c.update(frame(spark, []), frame(spark, [("c", "goal")]))
    assert found(c) == want(edges, ["goal", "a"]) == {("a", "b"), ("a", "c"), ("a", "x")}


def test_cost_follows_the_change(spark, tmp_path):
    """A hundred chains: an edge of one of them renews the buckets of its ends and of what lies above."""
    edges = {(f"{k}_{i + 1}", f"{k}_{i}") for k in range(100) for i in range(4)}
    c = Closure.build(frame(spark, sorted(edges)), seeds(spark, [f"{k}_0" for k in range(100)]), f"file://{tmp_path}/c", buckets=16)
    assert c.renewed["reach"] == 16
    d = c.update(frame(spark, []), frame(spark, [("7_2", "7_1")]))
    assert d.renewed == {"into": 1, "out": 1, "reach": len(set(d.places["reach"]) & {str(r[0]) for r in spark.createDataFrame([("7_2",), ("7_3",), ("7_4",)], "id string").select(d._bucket("id")).distinct().collect()})}
    assert found(d) == want(edges - {("7_2", "7_1")}, [f"{k}_0" for k in range(100)])
    same = d.update(frame(spark, [("8_1", "8_0")]), frame(spark, [("7_2", "7_1")]))
    assert same.renewed == {"into": 0, "out": 0, "reach": 0} and same.places == d.places


def test_empty_graph_and_two_writers(spark, tmp_path):
    c = Closure.build(frame(spark, []).limit(0), seeds(spark, ["a"]), f"file://{tmp_path}/c", buckets=2)
    assert found(c) == set()
    d = c.update(frame(spark, [("b", "a")]), frame(spark, []))
    assert found(d) == {("a", "b")}
    with pytest.raises(RuntimeError):
        c.update(frame(spark, [("z", "a")]), frame(spark, []))
    assert found(Closure(spark, f"file://{tmp_path}/c")) == {("a", "b")}


def dealt(spark, after=-1):
    """(last stage, rows that stages after a given one have written to exchanges)."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    every = jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(every, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    seen = [(stages.apply(i).stageId(), stages.apply(i).shuffleWriteRecords()) for i in range(stages.size())]
    return max((i for i, _ in seen), default=-1), sum(n for i, n in seen if i > after)


def test_a_large_change_is_dealt_a_few_times(spark, tmp_path):
    """All calls of the lowest nodes go, all their reads come. No table is small enough for a broadcast."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    base = {(f"c{i}", "top") for i in range(20)} | {(f"s{i}", "top") for i in range(20)}
    calls, reads = {(f"o{i}", f"c{i % 20}") for i in range(1000)}, {(f"o{i}", f"s{(i + 3 * j) % 20}") for i in range(1000) for j in range(4)}
    c = Closure.build(frame(spark, sorted(base | calls)), seeds(spark, ["top"]), f"file://{tmp_path}/c", buckets=2)
    last, _ = dealt(spark)
    try:
        c = c.update(frame(spark, sorted(reads)), frame(spark, sorted(calls)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    _, n = dealt(spark, last)
    assert n < 10 * len(reads | calls), n
    assert found(c) == want(base | reads, ["top"])
