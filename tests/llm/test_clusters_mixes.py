"""Operators 11 and 12 against plain versions on small tables."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from codestrata.llm import kmeans, mixture
from tests.oracle import connect, difference


def plain_kmeans(rows, k, dim, rounds, seed=3):
    """Full scans with Python's integers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) < 1e5 for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)
    centroids = [v for _, _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        centroids = [[sum(x) // len(members[n]) for x in zip(*members[n], strict=True)] if n in members else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    per = defaultdict(int)
    for _, c, d in found:
        per[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(repr((i, c, d, per[c], sum(per.values()), sha[c])) for i, c, d in found)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance long").repartition(3)


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_clusters_are_those_of_full_scans(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 4)) * 3
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + rng.normal(size=4) * 0.4]) for i in range(300)]
    rows += [(900 + i, [0.5, -0.5, 0.25, 0.0]) for i in range(40)]  # one vector many times
    rows += [(7, [0.5, 0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5, 0.5]), (None, [1.0, 2.0, 3.0, 4.0])]
    rows += [(1, None), (2, []), (3, [1.0]), (4, [1.0, None, 2.0, 3.0]), (5, [1.0, float("nan"), 2.0, 3.0]), (6, [1.0, float("inf"), 2.0, 3.0]), (8, [3e38, 0.0, 0.0, 0.0])]
    for k, rounds in ((6, 10), (11, 3)):
        assert got(kmeans.cluster(frame(spark, rows), k, 4, rounds)) == plain_kmeans(rows, k, 4, rounds)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)]  # equal starts leave clusters empty
    assert got(kmeans.cluster(frame(spark, rows), 8, 2, 10)) == plain_kmeans(rows, 8, 2, 10)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_few_vectors(spark, rows):
    assert got(kmeans.cluster(frame(spark, rows), 8, 2, 10)) == plain_kmeans(rows, 8, 2, 10)


def test_bounds_spare_distances_and_change_nothing():
    rng = np.random.default_rng(1)
    v = np.floor(1024 * (rng.normal(size=(9, 16))[rng.integers(0, 9, 2000)] + 0.2 * rng.normal(size=(2000, 16)))).astype(np.int64)
    centroids = v[:12].copy()
    group = kmeans.grouped(centroids, 3)
    a, upper, lower = kmeans.assigned(v, centroids, group, 3)
    spared = 0
    for _ in range(8):
        new = np.array([v[a == c].sum(0) // (a == c).sum() if (a == c).any() else centroids[c] for c in range(12)])
        drift = np.sqrt(((new - centroids) ** 2).sum(1).astype(float)) * (1 + kmeans.SLACK)
        centroids = new
        a, upper, lower, computed = kmeans.moved(v, a, upper, lower, centroids, drift, group)
        full = kmeans.squares(v, centroids)
        assert (a == full.argmin(1)).all()
        far = np.sqrt(full)
        assert (upper >= far[np.arange(len(v)), a]).all()
        far[np.arange(len(v)), a] = np.inf
        assert all((lower[:, g] <= far[:, group == g].min(1, initial=np.inf)).all() for g in range(3))
        spared += len(v) * 12 - computed
    assert spared > 0.5 * 8 * len(v) * 12


def test_distances_of_large_integers_are_exact():
    v = np.array([[(1 << 27), -(1 << 27)], [5, 7]], dtype=np.int64)
    c = np.array([[-(1 << 27), (1 << 27)], [5, 8]], dtype=np.int64)
    assert kmeans.squares(v, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]


# --- mixture ----------------------------------------------------------------


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 3, 4.0) for i, t, s in rows], "doc_id long, text string, source string, size long, target double").repartition(3)


def plain_targets(sizes, total=1.5, cap=2.0, weights=(3, 1, 2)):
    """Shares again and again what is above, as the contract says it."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[n % 3] for n, s in enumerate(names)}
    out, open_, left = {}, set(names), total * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        above = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not above:
            return out | {s: w[s] * level for s in open_}
        for s in above:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= above
    return out


ROWS = [(i, " ".join(f"w{j}" for j in range(1 + i % 23)), f"s{i % 7}") for i in range(400)]
ROWS += [(1000 + i, "one two three", "hot") for i in range(600)]  # a third of all rows
ROWS += [(2000, "a b c d", "same")] * 90 + [(2001, "x " * 500, "same")]
ROWS += [(3000, None, "none"), (3001, "", "none"), (3002, " \n", None), (3003, "one word\x1cstill", None), (None, "no id", "é"), (None, "no id", "é"), (3004, "#$%", "𝄞"), (3005, "word " * 3000, "￿")]


def test_targets_and_words_taken(spark):
    rows = mixture.mix(documents(spark, ROWS)).collect()
    assert len(rows) == len(ROWS)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken >= r.epochs * r.size
    want = plain_targets(sizes)
    assert set(want) == set(targets)
    for s, t in want.items():
        assert targets[s] == pytest.approx(t, rel=1e-12) and {r.source_size for r in rows if r.source == s} == {sizes[s]}
        assert abs(taken[s] - t) <= (46 if s == "same" else 1)  # rows alike share the edge
    assert sorted(map(repr, rows)) == sorted(map(repr, mixture.mix(documents(spark, ROWS[::-1])).collect()))


def test_documents_go_by_key(spark):
    """All of smaller keys are drawn before any of a larger one, and one document a source at most is cut."""
    by = defaultdict(list)
    for r in mixture.mix(documents(spark, [x for x in ROWS if x[2] != "same"])).collect():
        if r.size:
            by[r.source].append((r.key, r.taken - r.epochs * r.size, r.size))
    for rows in by.values():
        parts = [drawn / size for _, drawn, size in sorted(rows)]
        assert parts == sorted(parts, reverse=True) and sum(0 < p < 1 for p in parts) <= 1


def test_rows_alike_share_the_edge(spark):
    rows = mixture.mix(documents(spark, [(1, "a b c d e f g h", "x")] * 6 + [(2, "a " * 300, "y")])).where("doc_id = 1").collect()
    assert len({r.taken for r in rows}) == 1


def test_better_documents_are_drawn_more(spark):
    rows = [(i, "good words only here" if i % 2 else "4444 55$5 6666 ab12", "a") for i in range(2000)] + [(9000 + i, "word " * 50, "b") for i in range(400)]
    found = mixture.mix(documents(spark, rows), weights=(1.0, 40.0), total=0.9).where("source = 'a'").collect()
    good = [sum(r.taken > 0 for r in found if r.doc_id % 2 == odd) for odd in (0, 1)]
    assert good[1] > 2 * good[0] > 0


def test_finer_cells_meet_the_edge(spark, monkeypatch):
    """With few cells many documents lie in the last one; the result is the same."""
    want = sorted(map(repr, mixture.mix(documents(spark, ROWS)).collect()))
    monkeypatch.setattr(mixture, "CELLS", 2)
    assert sorted(map(repr, mixture.mix(documents(spark, ROWS)).collect())) == want


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b", None)]])
def test_small_tables(spark, rows):
    got = mixture.mix(documents(spark, rows)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(len((t or "").split()), 1.5 * len((t or "").split()), 3 * len((t or "").split()) // 2) for _, t, _ in rows]


def test_sources_are_numbered_over_ranges(spark):
    sources = spark.createDataFrame([(f"s{i:05}", 1) for i in range(3000)] + [(None, 1)], "source string, n int").repartition(7)
    found = {r.source: r.place for r in mixture.numbered(sources).collect()}
    assert found == {**{f"s{i:05}": i for i in range(3000)}, None: 3000}


def test_sql(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    for name in ("op11_yinyang", "op12_mixture"):
        assert not difference(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name])
