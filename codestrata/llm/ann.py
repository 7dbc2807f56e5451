"""Nearest neighbours by adaptive dimension scans over probed lists (operator 7).

Largest inner product becomes least distance by one more coordinate,
sqrt(M**2 - |x|**2) for a candidate and 0 for a query, M the largest norm.
Vectors are rotated at random, so the first t of D coordinates give an unbiased
estimate of a distance with known spread. Lists are k-means cells, as many as
the root of the number of vectors; a query probes its nearest cells. What share
of them is measured on the sample that the cells are fitted on: the least with
a recall of TARGET there. Vectors with clusters need few lists, those without
need many.

Within a list, rotated vectors are read in column blocks, and after each a
hypothesis test abandons the candidates whose partial distance shows, at
EPSILON deviations, that they lie beyond the query's current k-th. While most
pairs are alive a block is one matrix product; once few are, only those are
carried on. Survivors are ranked by exact inner products of the original
vectors, in double precision.

Neighbouring lists are put on one *shelf* of about SHELF vectors, and a list
that is larger is cut into several, so one vector, or one list, that holds a
third of all rows is scanned by many tasks. Shelves meet blocks of the queries
that probe a list on them. Each query's nearest lists are scanned first; its k-th
there bounds the scans of the others from the start, which then return only
what reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import about, bounded, stored

NEAREST = 20
#: Vectors, and numbers in them, that centroids are fitted on, at most; every vector is indexed.
FIT_ROWS, FIT_NUMBERS = 16_384, 1 << 22
#: Lists, at most. Beyond its square in vectors, lists grow.
CELLS = 4_096
#: Recall that the share of probed lists has to reach on ASKED vectors of the sample, and how many vectors the probed lists hold at least.
TARGET, ASKED, LEAST_PROBED = 0.95, 256, 1_000
#: Share of the lists that is scanned first, for a bound.
FIRST = 0.05
SHELF, QUERIES = 2_048, 256
COLUMNS = 16
EPSILON = 2.1
#: Below this share of living pairs they are carried on one by one.
SPARSE = 1 / 16

#: nr tells the vectors of one query id apart.
FOUND = "query_id long, nr long, vec_id long, score double"


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(7)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: with an id, not null or empty, finite throughout and not all zero, of the commonest (then longest) dimension."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return fine.where(F.size("v") == (sizes[0].d if sizes else 0))


def _order(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The cells from the nearest to the farthest, for each point."""
    return ((c * c).sum(1)[None] - 2 * points @ c.T).argsort(1, kind="stable")


def _nearest_cell(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    norm = (c * c).sum(1)[None]
    return np.concatenate([(norm - 2 * points[i : i + 2048] @ c.T).argmin(1) for i in range(0, len(points), 2048)]) if len(points) else np.zeros(0, int)


def centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """k-means from rows spread over the sample; an emptied cell keeps its place. Cells come in the order of their main direction, so that neighbours share shelves."""
    c = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest_cell(sample, c)
        n = np.bincount(near, minlength=cells)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c[np.argsort((c - c.mean(0)) @ np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0], kind="stable")]


def probes_needed(sample: np.ndarray, lifted: np.ndarray, c: np.ndarray, k: int, target: float) -> int:
    """How many cells queries must probe for the target recall, measured: ASKED rows of the sample against all of it."""
    asked = np.linspace(0, len(sample) - 1, min(ASKED, len(sample))).astype(int)
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(c)
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    order = _order(np.hstack([sample[asked], np.zeros((len(asked), 1))]), c)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None], axis=1)
    found = np.sort(np.take_along_axis(place, _nearest_cell(lifted, c)[near], axis=1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(target * len(found))) - 1)]) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(most - (v * v).sum(1, keepdims=True), 0))])


class Lists:
    """What the tasks know of the lists: centroids, how many vectors each holds, its shelf, how many are probed. At most CELLS rows."""

    def __init__(self, c: np.ndarray, most: float, sizes: np.ndarray, probed: int):
        self.c, self.most, self.sizes, self.probed = c, most, sizes, probed
        self.shelf = (np.cumsum(sizes) - sizes) // SHELF
        large = sizes > SHELF  # has a shelf of its own, cut into parts
        self.shelf = np.cumsum(np.append(0, (self.shelf[1:] != self.shelf[:-1]) | large[1:] | large[:-1]))
        self.parts = np.ones(int(self.shelf[-1]) + 1, dtype=np.int64)
        self.parts[self.shelf[large]] = -(-sizes[large] // SHELF)

    def chosen(self, queries: np.ndarray, begin: int, stop: int) -> np.ndarray:
        """Which lists each query probes from its begin-th to before its stop-th nearest, and on until they hold LEAST_PROBED vectors (if stop is all it probes)."""
        order = _order(np.hstack([queries, np.zeros((len(queries), 1))]), self.c)
        held = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        place = np.arange(len(self.c))[None]
        taken = (place >= begin) & ((place < stop) | ((held < LEAST_PROBED) & (stop >= self.probed)))
        out = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(out, order, taken, axis=1)
        return out


def _cells(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    c, most = sent.value
    for batch in batches:
        v = _matrix(batch.column(1))
        cell = _nearest_cell(_lifted(v, most), c) if len(v) else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32())], names=["vec_id", "v", "cell"])


def _probes(batches: Iterator[pa.RecordBatch], sent, begin: int, stop: int) -> Iterator[pa.RecordBatch]:
    """The shelves that each query (query_id, q, floor, nr) has to look at, a row for each."""
    lists = sent.value
    edges = np.flatnonzero(np.append(True, lists.shelf[1:] != lists.shelf[:-1]))
    for batch in batches:
        v = _matrix(batch.column(1))
        if len(v):
            rows, shelf = np.nonzero(np.logical_or.reduceat(lists.chosen(v, begin, stop), edges, axis=1))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in range(4)), pa.array(shelf, pa.int32())], names=["query_id", "q", "floor", "nr", "shelf"])


def living(queries: np.ndarray, vectors: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (query, vector) of rotated rows that no test abandons: squared distances within bound, or among the k least where it is infinite."""
    d = vectors.shape[1]
    grid, pairs, u = np.zeros((len(queries), len(vectors))), None, 0
    while u < d:
        t, u = u, min(u + COLUMNS, d)
        a, b = queries[:, t:u], vectors[:, t:u]
        if pairs is None:
            grid += (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        else:
            pairs = (*pairs[:2], pairs[2] + ((a[pairs[0]] - b[pairs[1]]) ** 2).sum(1))
        if u == d:
            break
        limit = bound * (u / d) * (1 + EPSILON / np.sqrt(u)) ** 2 + 1e-9
        if pairs is not None:
            alive = pairs[2] <= limit[pairs[0]]
            pairs = tuple(x[alive] for x in pairs)
        else:
            alive = grid <= limit[:, None]
            if alive.sum() < SPARSE * alive.size:
                row, col = np.nonzero(alive)
                pairs = row, col, grid[row, col]
            else:
                grid[~alive] = np.inf
    if pairs is None:
        none = ~np.isfinite(bound)
        if none.any():
            part = grid[none]
            bound = bound.copy()
            bound[none] = np.partition(part, k - 1, axis=1)[:, k - 1] if part.shape[1] > k else np.inf
        row, col = np.nonzero((grid <= (bound * (1 + 1e-9) + 1e-9)[:, None]) & (grid < np.inf))
        return row, col
    alive = pairs[2] <= bound[pairs[0]] * (1 + 1e-9) + 1e-9
    return pairs[0][alive], pairs[1][alive]


def scan(queries: np.ndarray, rotated_queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, rotated: np.ndarray, ids: np.ndarray, cell: np.ndarray, wanted: np.ndarray, floor: np.ndarray, most: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k nearest on a shelf, of those that reach its floor: (query, id, inner product), nearest first, ties to the smaller id.

    Vectors come in the order of their cells. wanted says which cells a query
    probes, floor is the least inner product of interest, most the largest
    squared norm. List by list the k-th so far becomes the bound.
    """
    kth, norm = floor.copy(), (rotated_queries**2).sum(1) + most
    pool = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))

    def best(pool):
        row, ident, score = pool
        order = np.lexsort((ident, -score, row))
        row = row[order]
        begin = np.searchsorted(row, np.arange(len(queries)))
        rank = np.arange(len(row)) - begin[row]
        last = order[rank == k - 1]
        kth[pool[0][last]] = np.maximum(kth[pool[0][last]], score[last])
        order = order[rank < k]
        return tuple(x[order] for x in pool)

    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else []
    for start, stop in zip(starts, [*starts[1:], len(cell)], strict=True):
        asked = np.flatnonzero(wanted[:, cell[start]])
        if not len(asked):
            continue
        bound = norm[asked] - 2 * kth[asked]
        bound = bound + 1e-9 * (np.abs(bound) + most + 1)
        known = np.sort(ids[start:stop])
        itself = (np.searchsorted(known, own[asked], "right") - np.searchsorted(known, own[asked])).max()  # rows with the query's own id
        row, col = living(rotated_queries[asked], rotated[start:stop], bound, k + int(itself))
        row, col = asked[row], col + start
        fine = ids[col] != own[row]
        row, col = row[fine], col[fine]
        score = (vectors[col] * queries[row]).sum(1)
        fine = score >= kth[row]
        pool = tuple(np.concatenate(x) for x in zip(pool, (row[fine], ids[col[fine]], score[fine]), strict=True))
        pool = best(pool)
    return pool


def _scan(batches: Iterator[pa.RecordBatch], sent, turn, begin: int, stop: int, k: int) -> Iterator[pa.RecordBatch]:
    lists = sent.value
    for batch in batches:
        for i in range(batch.num_rows):
            ids, cell, own, floor, nrs = (np.asarray(batch.column(c)[i].values) for c in (0, 2, 3, 5, 6))
            v, q = (np.asarray(batch.column(c)[i].values.flatten()).reshape(n, -1) for c, n in ((1, len(ids)), (4, len(own))))
            order = np.argsort(cell, kind="stable")
            ids, cell, v = ids[order], cell[order], v[order]
            x, y = _lifted(v, lists.most) @ turn.value, np.hstack([q, np.zeros((len(q), 1))]) @ turn.value
            row, ident, score = scan(q, y, own, v, x, ids, cell, lists.chosen(q, begin, stop), floor, lists.most, k)
            yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(nrs[row]), pa.array(ident), pa.array(score)], names=["query_id", "nr", "vec_id", "score"])


def nearest(vectors: DataFrame, every: int = 20, k: int = NEAREST, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every`` its k nearest other rows by inner product.

    score is the inner product in double precision on the original vectors;
    ties go to the smaller vec_id. Null ids, null, empty or zero vectors, and
    vectors with null or non-finite components take no part, nor do those of
    another dimension than most have. A row that repeats an id is never its own
    id's neighbour. Rows that repeat a query's id and vector are one query; each
    other vector of the id is a query with ranks of its own. Vectors of any
    length are read whole. Other columns are ignored. No rows give no rows.
    """
    spark: SparkSession = bounded(vectors.sparkSession)
    usable = stored(_usable(vectors), "vectors")
    head = usable.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("most"), F.max(F.size("v")).alias("d")).first()
    if not head.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fit = max(1, min(FIT_ROWS, FIT_NUMBERS // head.d))
    sample = _matrix(about(usable, "vec_id", fit, head.n).orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit).select("v").toArrow().column("v").combine_chunks())
    lifted = _lifted(sample, head.most)
    c = centroids(lifted, int(np.clip(np.sqrt(head.n), 1, min(CELLS, -(-len(sample) // 4)))))
    fitted = spark.sparkContext.broadcast((c, head.most))  # at most CELLS rows
    listed = stored(usable.mapInArrow(lambda it: _cells(it, fitted), "vec_id long, v array<double>, cell int"), "lists")
    counts = {r.cell: r.n for r in listed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most CELLS rows
    lists = Lists(c, head.most, np.array([counts.get(i, 0) for i in range(len(c))]), probes_needed(sample, lifted, c, k, target))
    sent, turn = spark.sparkContext.broadcast(lists), spark.sparkContext.broadcast(rotation(lifted.shape[1]))

    shelves = spark.createDataFrame([(i, int(s), int(lists.parts[s])) for i, s in enumerate(lists.shelf)], "cell int, shelf int, parts long")
    placed = listed.join(F.broadcast(shelves), "cell")  # at most CELLS rows
    blocks = placed.groupBy("shelf", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("vec_id", "v", "cell")).alias("x"))
    blocks = stored(blocks.select("shelf", F.col("x.vec_id").alias("ids"), F.col("x.v").alias("vs"), F.col("x.cell").alias("cells")), "blocks")
    groups = max(1, int(head.n / every / QUERIES))
    order = Window.partitionBy("query_id", "nr").orderBy(F.desc("score"), "vec_id")

    def search(asked: DataFrame, begin: int, stop: int) -> DataFrame:
        """The nearest of asked (query_id, q, floor, nr) in their lists begin : stop."""
        probes = asked.mapInArrow(lambda it: _probes(it, sent, begin, stop), "query_id long, q array<double>, floor double, nr long, shelf int")
        met = probes.groupBy("shelf", F.pmod(F.xxhash64("query_id", "q"), F.lit(groups)).alias("part")).agg(F.collect_list(F.struct("query_id", "q", "floor", "nr")).alias("y"))
        met = stored(met.select(F.col("shelf").alias("asked"), F.col("y.query_id").alias("queries"), F.col("y.q").alias("qs"), F.col("y.floor").alias("floors"), F.col("y.nr").alias("nrs")), "queries")
        pairs = blocks.join(met, F.col("shelf") == F.col("asked")).select("ids", "vs", "cells", "queries", "qs", "floors", "nrs")
        found = pairs.mapInArrow(lambda it: _scan(it, sent, turn, begin, stop, k), FOUND)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked = usable.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    asked = stored(asked.select("query_id", "q", F.lit(float("-inf")).alias("floor"), F.xxhash64("q").alias("nr")), "asked")
    head_lists = max(1, min(lists.probed - 1, round(FIRST * len(c))))
    found = stored(search(asked, 0, head_lists).drop("rank"), "first")
    if len(c) > 1:
        floors = found.groupBy("query_id", "nr").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
        floored = asked.drop("floor").join(floors, ["query_id", "nr"], "left").select("query_id", "q", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "nr")
        found = found.unionByName(search(floored, head_lists, max(lists.probed, head_lists)).drop("rank"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
