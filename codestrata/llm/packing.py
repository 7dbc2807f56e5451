"""Best-fit packing by a linear grouping scheme (operator 2).

Lengths are at most ``capacity``, so a corpus of any size is a histogram of as
many numbers. That histogram alone is planned on the driver:

1. Lengths over a small share of the capacity are large. They are cut, in order
   of length, into groups of equal cardinality; every length is rounded up to
   its group's largest.
2. Configurations of those few sizes are optimised by column generation (the
   Gilmore-Gomory linear programme with an exact knapsack for pricing).
3. Whole multiples of the configurations are opened, and actual documents take
   the places of the rounded ones.
4. What is left over, then all small lengths, longest first, go where they fit
   best into the space that remains; only what fits nowhere opens a sequence.

The plan says, for the r-th document of each length, its sequence and offset.
Ranks come from a window over (length, salt), so a length that a third of all
rows has is ranked by many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_level
from .shared import bounded, stored

CAPACITY = 1024
END_ID = 2
GROUPS = 128
#: Rows of one length that one task ranks, about.
RANKED = 10_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations (how often each size) with how many of each, of the least total, as a basic solution."""
    k = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    amount = demand / np.diag(columns)
    most = int(capacity // sizes.min())
    room = np.arange(capacity + 1)
    for _ in range(30 * k):
        price = np.linalg.solve(columns.T, np.ones(k))
        best, taken = np.zeros(capacity + 1), []
        for _ in range(most):  # one more item each time
            at = room[None, :] - sizes[:, None]
            value = np.where(at >= 0, best[np.maximum(at, 0)] + price[:, None], 0)
            item = value.argmax(axis=0)
            top = value[item, room]
            gain = top > best + 1e-12
            taken.append(np.where(gain, item, -1))
            best = np.where(gain, top, best)
            if not gain.any():
                break
        if best[capacity] <= 1 + 1e-7:
            break
        column, left = np.zeros(k), capacity
        for step in reversed(taken):
            if (i := step[left]) >= 0:
                column[i] += 1
                left -= sizes[i]
        change = np.linalg.solve(columns, column)
        ratio = np.where(change > 1e-9, np.maximum(amount, 0) / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        amount = amount - ratio[out] * change
        amount[out] = ratio[out]
        columns[:, out] = column
    return [(columns[:, i].astype(int), a) for i, a in enumerate(amount) if a > 1e-9]


class Plan:
    """Where the r-th item of each length goes. ``rows``: (length, first rank, per sequence, first sequence, offset), by length and rank."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = 1 / 8):
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self._rank = dict.fromkeys(counts, 0)
        self._left = {n: c for n, c in counts.items() if c > 0}
        self._space: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (first sequence, how many)
        self._free: list[int] = []
        self._grouped(groups, small)
        for length in sorted(self._left, reverse=True):
            self._best_fit(length)
        self.rows.sort()

    def _put(self, length: int, run: tuple[int, int], used: int, each: int = 1) -> None:
        first, n = run
        self.rows.append((length, self._rank[length], each, first, used))
        self._rank[length] += n * each
        self._left[length] -= n * each

    def _offer(self, run: tuple[int, int], used: int) -> None:
        free = self.capacity - used
        if free and run[1]:
            if free not in self._space:
                self._space[free] = []
                insort(self._free, free)
            self._space[free].append(run)

    def _open(self, n: int) -> tuple[int, int]:
        self.sequences += n
        return self.sequences - n, n

    def _grouped(self, groups: int, small: float) -> None:
        large = sorted((n for n in self._left if small * self.capacity < n < self.capacity), reverse=True)
        if not large:
            return
        each = -(-sum(self._left[n] for n in large) // groups)
        parts: list[list[int]] = []
        held = each
        for n in large:
            if held >= each or len(large) <= groups:
                parts.append([])
                held = 0
            parts[-1].append(n)
            held += self._left[n]
        demand = np.array([sum(self._left[n] for n in part) for part in parts], dtype=float)
        found = _configurations(np.array([part[0] for part in parts]), demand, self.capacity)
        lengths_up = large[::-1]
        for config, amount in sorted(found, key=lambda x: -x[1]):
            slots = [g for g, times in enumerate(config) for _ in range(times)]
            n = int(amount + 1e-6)
            while n > 0:  # as long as every place has a document of one actual length
                lengths, need, free = [], {}, self.capacity
                for k, g in enumerate(slots):
                    x = next((x for x in parts[g] if self._left[x] > need.get(x, 0)), 0)
                    if k == len(slots) - 1:  # the last place also gets what rounding up had set aside
                        i = bisect_right(lengths_up, free)
                        while i and self._left[lengths_up[i - 1]] <= need.get(lengths_up[i - 1], 0):
                            i -= 1
                        x = max(x, lengths_up[i - 1] if i else 0)
                    if not x:
                        break
                    lengths.append(x)
                    need[x] = need.get(x, 0) + 1
                    free -= x
                else:
                    m = min(n, *(self._left[x] // times for x, times in need.items()))
                    run, used = self._open(m), 0
                    for x in lengths:
                        self._put(x, run, used)
                        used += x
                    self._offer(run, used)
                    n -= m
                    continue
                break

    def _best_fit(self, length: int) -> None:
        while self._left[length]:
            i = bisect_left(self._free, length)
            if i < len(self._free):
                free = self._free[i]
                runs = self._space[free]
                first, n = runs.pop()
                if not runs:
                    del self._space[free]
                    self._free.pop(i)
                m = min(n, self._left[length])
                self._offer((first + m, n - m), self.capacity - free)
                self._put(length, (first, m), self.capacity - free)
                self._offer((first, m), self.capacity - free + length)
            else:
                each = min(self.capacity // length, self._left[length])
                run = self._open(self._left[length] // each)
                self._put(length, run, 0, each)
                self._offer(run, each * length)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.array(self.rows, dtype=np.int64).reshape(-1, 5)
        at = np.searchsorted((rows[:, 0] << 44) + rows[:, 1], (length << 44) + rank, side="right") - 1
        far = rank - rows[at, 1]
        return rows[at, 3] + far // rows[at, 2], rows[at, 4] + far % rows[at, 2] * length


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, end = byte_level(path).encode, np.array([end_id], dtype="<u4").tobytes()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * keep_ids]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
            ids += end
            n = len(ids) // 4
            stop = n % capacity or capacity
            start = piece = 0
            while start < n:
                cut = ids[4 * start : 4 * stop]
                rows.append((doc_id, piece, start, stop - start, zlib.crc32(cut), *[cut] * keep_ids))
                start, stop, piece = stop, stop + capacity, piece + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, with keep_ids also ids.

    A document's ids are the tokenizer file's for its whole text, then end_id.
    One longer than ``capacity`` is cut into pieces of just that many, the first
    being what is over. Sequences hold at most ``capacity`` and have no gaps.

    Null or empty text: the end id alone. Texts of any length are encoded whole
    and cut into as many pieces as they need. Repeated rows and null ids are
    packed like any others. Other columns are ignored. No rows give no rows.
    """
    bounded(docs.sparkSession)
    schema = PIECES + ", ids binary" * keep_ids
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stored(base.mapInArrow(lambda it: _pieces(it, tokenizer, end_id, capacity, keep_ids), schema), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = Plan(counts, capacity)

    salts = max(1, -(-sum(counts.values()) // RANKED))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(begins, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("begin"))

    kept = [f.split()[0] for f in schema.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(np.asarray(batch.column("length")), np.asarray(batch.column("rank")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "rank").mapInArrow(place, schema + ", sequence_id long, offset long")
