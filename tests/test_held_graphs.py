"""Walks over a graph that is built once, and paths that are looked for from the side with fewer nodes."""

import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import traverse


def counted_edges(spark, pairs):
    """Edges that count how often a row of theirs is made."""
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            made.add(len(b))
            yield b

    schema = "from_id string, to_id string, confidence string"
    return spark.createDataFrame([(a, b, "resolved") for a, b in pairs], schema).mapInPandas(rows, schema), made


def test_flow_and_trace_build_their_graph_once(spark):
    pairs = [("c", "b"), ("b", "a"), ("d", "b")]
    edges, made = counted_edges(spark, pairs)
    got = {(r.id, r.direction, r.depth) for r in traverse.flow(edges, spark.createDataFrame([("b",)], "seed string")).collect()}
    assert got == {("c", "upstream", 1), ("d", "upstream", 1), ("a", "downstream", 1)} and made.value == len(pairs)
    edges, made = counted_edges(spark, pairs)
    nodes = spark.createDataFrame([(x, "frontend" if x == "c" else "code") for x in "abcd"], "id string, layer string")
    got = {(r.id, r.layer, r.depth, r.on_path) for r in traverse.trace(edges, nodes, "a").collect()}
    assert got == {("a", "code", 0, True), ("b", "code", 1, True), ("c", "frontend", 2, True), ("d", "code", 2, False)} and made.value == len(pairs)


def test_a_path_leaves_a_hub_alone(spark, monkeypatch):
    pairs = [("s", "m"), ("m", "k"), ("k", "goal")] + [(f"x{i}", "k") for i in range(3000)] + [(f"y{i}", "goal") for i in range(3)]
    most, store = [], traverse.stored

    def counting(df, name="table"):
        out = store(df, name)
        if name == "frontier":
            most.append(out.count())
        return out

    monkeypatch.setattr(traverse, "stored", counting)
    e = spark.createDataFrame(pairs, "from_file string, to_file string")
    assert [r.id for r in traverse.find_path(e, "s", "goal").orderBy("step").collect()] == ["s", "m", "k", "goal"]
    assert max(most) < 100


@pytest.mark.parametrize("seed", [1, 2])
def test_least_path(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(16)}", f"n{rng.randrange(16)}") for _ in range(34)}
    goals = ["n3", "n5"]
    level = [["n0"]]
    for _ in range(16):
        if done := [p for p in level if p[-1] in goals]:
            break
        level = [p + [b] for p in level for a, b in pairs if a == p[-1] and b not in p]
    e = spark.createDataFrame(sorted(pairs), "from_file string, to_file string").orderBy(F.rand(1))
    assert [r.id for r in traverse.find_path(e, "n0", goals).orderBy("step").collect()] == (min(done) if done else [])
