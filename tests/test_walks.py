"""Walks from many sources against plain searches on random graphs with cycles."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from codestrata.operators import govern, traverse
from codestrata.operators.walks import counted, pairs, walk


def graph(n, m, seed):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)})


def depths(edges, seed, starts=False):
    """Least number of steps (one at least) from each node to the seed."""
    back = {}
    for a, b in edges:
        back.setdefault(b, set()).add(a)
    found, queue = {}, deque([(seed, 0)])
    while queue:
        node, d = queue.popleft()
        for x in back.get(node, ()):
            if x not in found and (starts or x != seed):
                found[x] = d + 1
                queue.append((x, d + 1))
    return found


def frame(spark, edges):
    return spark.createDataFrame([(a, b, "resolved") for a, b in edges] + [(None, "n1", "resolved"), ("n1", None, "resolved")], "from_id string, to_id string, confidence string")


@pytest.mark.parametrize("starts", [False, True])
def test_depths_of_all_pairs(spark, starts):
    edges = graph(150, 190, 1)
    names = [f"n{i}" for i in range(150)]
    w = walk(frame(spark, edges), spark.createDataFrame([(s,) for s in [*names, None, "n0", "nowhere"]], "seed string"), starts=starts)
    got = {(r.seed, r.id): r.depth for r in pairs(w.levels, w.seeds).collect()}
    want = {(s, x): d for s in names for x, d in depths(edges, s, starts).items()}
    assert got == want
    assert {r.seed: r.n for r in counted(w.levels.select("block", "bits"), w.seeds).collect()} == {s: n for s in names if (n := len(depths(edges, s, starts)))}
    assert w.levels.count() < len(want)


def test_a_level_has_a_row_for_each_node_and_not_for_each_pair(spark):
    """64 files below four layers of 64: what is shuffled is measured against the pairs of seed and node."""
    rng = random.Random(9)
    edges = sorted({(f"l{k + 1}_{i}", f"l{k}_{rng.randrange(64)}") for k in range(4) for i in range(64) for _ in range(4)})
    w = walk(frame(spark, edges), spark.createDataFrame([(f"l0_{i}",) for i in range(64)], "seed string"))
    reached = sum(r.n for r in counted(w.levels.select("block", "bits"), w.seeds).collect())
    blocks = w.seeds.select("block").distinct().count()
    assert reached == sum(len(depths(edges, f"l0_{i}")) for i in range(64))
    assert w.levels.count() <= 4 * 64 * blocks and w.levels.count() * 5 < reached


def test_walks_stop_after_enough(spark):
    edges = [(f"n{i + 1}", f"n{i}") for i in range(200)] + [("m1", "m0")]
    w = walk(frame(spark, edges), spark.createDataFrame([("n0",), ("n190",), ("m0",)], "seed string"), enough=10)
    assert {r.seed: r.n for r in counted(w.levels.select("block", "bits"), w.seeds).collect()} == {"n0": 11, "n190": 10, "m0": 1}
    assert [r.seed for r in pairs(w.stopped, w.seeds).collect()] == ["n0"]


def test_diff_impact(spark):
    edges = graph(60, 80, 2)
    changed = ["n1", "n2", "n3", "n4"]
    for most, used in ((30, changed), (3, changed[:3])):
        got = {(r.id, r.depth, r.hits, r.truncated) for r in traverse.diff_impact(frame(spark, edges), spark.createDataFrame([(c,) for c in changed + ["n1"]], "id string"), most).collect()}
        want = {}
        for s in used:
            for x, d in depths(edges, s).items():
                if x not in used:
                    low, hits = want.get(x, (d, 0))
                    want[x] = min(low, d), hits + 1
        assert got == {(x, d, h, most == 3) for x, (d, h) in want.items()}


def test_file_impact_counts_a_file_on_a_cycle(spark):
    edges = graph(70, 90, 3)
    files = frame(spark, edges).toDF("from_file", "to_file", "confidence")
    names = [f"n{i}" for i in range(70)]
    got = {(r.file, r.direct, r.transitive) for r in traverse.file_impact(files, spark.createDataFrame([(x,) for x in names], "file string")).collect()}
    assert got == {(x, len({a for a, b in edges if b == x}), len(d)) for x in names if (d := depths(edges, x, True))}


def test_index_with_depth_and_with_a_cap(spark):
    edges = [e for e in graph(90, 140, 4) if e[0] != e[1]]
    files = frame(spark, edges).toDF("from_file", "to_file", "confidence")
    got = {r.file: r for r in traverse.impact_index(files, max_depth=3, listed_direct=2, listed=4).collect()}
    capped = {r.file: r for r in traverse.impact_index(files, max_depth=50, listed=4, max_nodes=6).collect()}
    for x in {b for _, b in edges}:
        d = depths(edges, x)
        near = sorted(n for n in d if d[n] <= 3)
        direct = sorted(n for n in d if d[n] == 1)
        assert (got[x].direct, got[x].transitive, got[x].direct_files, got[x].transitive_files, got[x].truncated) == (len(direct), len(near), direct[:2], near[:4], max(d.values()) > 3)
        nearest = sorted(sorted(d, key=lambda n: (d[n], n))[:6])
        assert (capped[x].transitive, capped[x].transitive_files, capped[x].truncated) == (len(nearest), nearest[:4], len(d) > 6)
    assert set(got) == set(capped) == {b for _, b in edges}


def test_review_says_when_more_has_changed(spark):
    edges = frame(spark, graph(40, 60, 5)).withColumn("to_kind", F.lit("code"))
    owners = spark.createDataFrame([("n1", "ann")], "id string, author string")
    none = spark.createDataFrame([], "id string, decision string")
    rows = govern.pr_review(edges, spark.createDataFrame([(f"n{i}",) for i in range(8)], "id string"), owners, none, None, most=5).collect()
    assert [r.n for r in rows if r.section == "truncated"] == [5]
    assert {r.key: r.n for r in rows if r.section == "impact"} == {s: n for i in range(5) if (n := len(depths(graph(40, 60, 5), s := f"n{i}")))}
