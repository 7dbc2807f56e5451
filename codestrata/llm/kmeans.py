"""Exact k-means over integer vectors by Yinyang grouping (operator 11).

Components become integers, floor(SCALE * x), so distances, sums and centroids
are exact and don't depend on the order in which tasks finish.

Centroids are clustered into groups once. Each vector keeps its cluster, an
upper bound of the distance to it, and one lower bound per group for the
distance to the nearest other centroid of that group. A round moves the bounds
by what the centroids moved; a vector whose bounds are apart is left alone
(global filter), the others meet only groups whose bound is not (group filter),
and there only centroids that their own move could have brought near enough.
Those are scanned exactly. Equal distances go to the smaller number, so a bound
that equals the distance is no reason to skip.

What a round leaves behind is one table of the vectors with their bounds; the
one before it is deleted. New centroids follow from the vectors that changed
their cluster: partial sums of Arrow batches, one row per batch and cluster,
summed per cluster. The driver holds k centroids and k sums, nothing per vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, discard, stored

SCALE = 1024
#: Centroids to a group, about.
GROUP = 4
#: Bounds give way by this share of themselves in each round: more than rounding can take.
SLACK = 1e-12


def limit(components: int) -> int:
    """Integers of less than this size have squared distances that fit a long."""
    return min(1 << 30, math.isqrt((1 << 61) // components))


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid, by five rounds of plain k-means over the centroids, which start from evenly spaced ones."""
    points = centroids.astype(float)
    heads = points[np.linspace(0, len(points) - 1, groups).astype(int)]
    for _ in range(5):
        near = ((points[:, None] - heads) ** 2).sum(2).argmin(1)
        heads = np.stack([points[near == g].mean(0) if (near == g).any() else heads[g] for g in range(groups)])
    return near


def squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors x centroids) as integers."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)), 1)
    if 4 * vectors.shape[1] * most * most < 1 << 53:  # every sum is an integer that a double holds
        v, c = vectors.astype(float), centroids.astype(float)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1)


def assigned(v: np.ndarray, centroids: np.ndarray, group: np.ndarray, n_groups: int) -> tuple:
    """(cluster, upper, lower): the first assignment, by all distances."""
    d = squares(v, centroids)
    a = d.argmin(1)
    return (a, *_bounds(np.sqrt(d), a, group, n_groups))


def _bounds(far: np.ndarray, a: np.ndarray, group: np.ndarray, n_groups: int) -> tuple:
    """Upper bound from the own centroid, lower bounds from the others, each with its slack."""
    rows = np.arange(len(a))
    upper = far[rows, a] * (1 + SLACK)
    far[rows, a] = np.inf
    lower = np.stack([far[:, group == g].min(1, initial=np.inf) for g in range(n_groups)], axis=1)
    return upper, lower * (1 - SLACK)


def moved(v: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray, group: np.ndarray) -> tuple:
    """(cluster, upper, lower, distances computed) after the centroids moved by ``drift``: exactly what a full scan gives."""
    n_groups, computed = lower.shape[1], 0
    by_group = np.array([drift[group == g].max(initial=0) for g in range(n_groups)])
    a, upper, before = a.copy(), (upper + drift[a]) * (1 + SLACK), lower
    lower = (lower - by_group) * (1 - np.sign(lower - by_group) * SLACK)
    live = np.flatnonzero(lower.min(1) <= upper)  # global filter
    if len(live):  # with the exact distance to the own centroid
        own = ((v[live] - centroids[a[live]]) ** 2).sum(1)
        computed += len(live)
        upper[live] = np.sqrt(own) * (1 + SLACK)
        still = lower[live].min(1) <= upper[live]
        live, own = live[still], own[still]
    if len(live):
        best, best_d, rows = a[live].copy(), own.copy(), np.arange(len(live))
        each = before[live][:, group] - drift  # a bound per centroid, by its own move
        each = each * (1 - np.sign(each) * SLACK)
        each[rows, best] = np.sqrt(own)
        for g in range(n_groups):  # group filter
            met = np.flatnonzero(lower[live, g] <= np.sqrt(best_d) * (1 + SLACK))
            for c in np.flatnonzero(group == g):
                scan = met[(each[met, c] <= np.sqrt(best_d[met]) * (1 + SLACK)) & (a[live[met]] != c)]
                if not len(scan):
                    continue
                d = ((v[live[scan]] - centroids[c]) ** 2).sum(1)
                computed += len(scan)
                each[scan, c] = np.sqrt(d)
                wins = (d < best_d[scan]) | ((d == best_d[scan]) & (c < best[scan]))
                best[scan[wins]], best_d[scan[wins]] = c, d[wins]
        each[rows, best] = np.sqrt(best_d)
        a[live] = best
        upper[live], lower[live] = _bounds(each, best, group, n_groups)
    return a, upper, lower, computed


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel(), kind))


_STATE = "id {id}, v array<int>, cluster int, was int, upper double, lower array<double>"


def _first(df: DataFrame, centroids: np.ndarray, group: np.ndarray, n_groups: int, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, upper, lower = assigned(_matrix(b["v"], centroids.shape[1], np.int64), centroids, group, n_groups)
                yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(a, pa.int32()), pa.nulls(len(a), pa.int32()), pa.array(upper), _lists(lower, pa.float64())], ["id", "v", "cluster", "was", "upper", "lower"])

    return df.mapInArrow(run, _STATE.format(id=id_type))


def _next(df: DataFrame, centroids: np.ndarray, drift: np.ndarray, group: np.ndarray, n_groups: int, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, was = _matrix(b["v"], centroids.shape[1], np.int64), b["cluster"].to_numpy()
                a, upper, lower, _ = moved(v, was, b["upper"].to_numpy(), _matrix(b["lower"], n_groups, float), centroids, drift, group)
                yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(a, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), _lists(lower, pa.float64())], ["id", "v", "cluster", "was", "upper", "lower"])

    return df.mapInArrow(run, _STATE.format(id=id_type))


def _changes(state: DataFrame, k: int, width: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, count, sums) of what came less what went, for the clusters that changed: k rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b["v"], width, np.int64)
            sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
            for name, sign in (("cluster", 1), ("was", -1)):
                at = b[name].fill_null(-1).to_numpy()
                for c in np.unique(at[at >= 0]):
                    sums[c] += sign * v[at == c].sum(0)
                    counts[c] += sign * (at == c).sum()
            some = np.flatnonzero(counts.astype(bool) | sums.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), _lists(sums[some], pa.int64())], ["cluster", "n", "sums"])

    part = state.where("was is null or was <> cluster").select("v", "cluster", "was").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return [(r[0], r[1], [int(x) for x in r[2:]]) for r in part.groupBy("cluster").agg(F.sum("n"), *total).collect()]


def cluster(vectors: DataFrame, k: int = 8, components: int = 64, rounds: int = 10, seed: int = 3, groups: int | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Usable are vectors of exactly ``components`` components, none null, not
    finite, or so large that a squared distance would not fit a long (SCALE * x
    of ``limit`` and more); the others have no row. Start centroids are the k
    usable vectors with the smallest sha256 of ``seed:id``; fewer vectors are
    fewer centroids. A null id takes part but is no start. Rows that repeat an id
    are vectors of their own; as starts, equal ids are taken by least vector.
    Equal distances go to the smaller number, empty clusters keep their centroid.
    A sum beyond a long is null. Other columns are not read. No rows give no rows.
    """
    spark = bounded(vectors.sparkSession)
    inside = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double") * SCALE) < limit(components), F.lit(False)))
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    # a case keeps floor() away from what can't be an int
    v = F.when((F.size(vector) == components) & inside, whole)
    table = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where("v is not null")
    id_type = table.schema["id"].dataType.simpleString()
    start = table.where("id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)).orderBy("h", "id", "v").limit(k)
    centroids = np.array([r["v"] for r in start.select("v").collect()], dtype=np.int64).reshape(-1, components)
    schema = f"{id_col} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    n = min(groups or -(-len(centroids) // GROUP), len(centroids))
    group = grouped(centroids, n)

    state = stored(_first(table, centroids, group, n, id_type), "yinyang")
    sums, counts = [[0] * components for _ in centroids], [0] * len(centroids)
    for _ in range(rounds):
        for c, came, more in _changes(state, len(centroids), components):
            counts[c] += came
            sums[c] = [s + m for s, m in zip(sums[c], more, strict=True)]
        new = np.array([[s // counts[c] for s in sums[c]] if counts[c] else list(map(int, centroids[c])) for c in range(len(centroids))], dtype=np.int64)
        drift = np.sqrt(((new - centroids) ** 2).sum(1).astype(float)) * (1 + SLACK)
        centroids = new
        if not drift.any():  # the same centroids assign alike for ever
            break
        old, state = state, stored(_next(state, centroids, drift, group, n, id_type), "yinyang")
        discard(old)
    return _report(state, centroids, id_col, schema)


def _report(state: DataFrame, centroids: np.ndarray, id_col: str, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = ((_matrix(b["v"], centroids.shape[1], np.int64) - centroids[b["cluster"].to_numpy()]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([b["id"], b["cluster"], pa.array(d)], [id_col, "cluster", "distance"])

    out = stored(state.select("id", "v", "cluster").mapInArrow(run, ", ".join(schema.split(", ")[:3])), "clusters")
    discard(state)
    by = F.try_sum("distance").alias("cluster_inertia")
    totals = out.groupBy("cluster").agg(by).withColumn("inertia", F.try_sum("cluster_inertia").over(Window.partitionBy()))  # k rows
    names = out.sparkSession.createDataFrame([(c, ",".join(map(str, v))) for c, v in enumerate(centroids.tolist())], "cluster int, line string")
    per = totals.join(names, "cluster").select("cluster", "cluster_inertia", "inertia", F.sha2("line", 256).alias("centroid_sha256"))
    return out.join(F.broadcast(per), "cluster").select(*[c.split()[0] for c in schema.split(", ")])
