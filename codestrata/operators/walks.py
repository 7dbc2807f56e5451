"""Walks from many sources at once: 64 of them share a long.

Sources are numbered in order; number n is bit n % 64 of block n / 64. A level of
a walk has one row for each node and block, whatever the number of sources that
have just met the node: frontiers are merged by ``bit_or`` before the shuffle,
and what was seen is taken off by one ``& ~``. Counts for each source are sums
of bits, 64 a block, so pairs of source and node are never shuffled; they are
only written out, by the task that has them, where a result lists them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import stored

WIDTH = 64
#: Levels that are read together before they are written as one.
KEPT = 32


@dataclass
class Walk:
    """seeds (seed, block, bit); levels (block, id, bits, depth), each bit of a block and node at its least depth; stopped (block, bits): sources that had met enough."""

    seeds: DataFrame
    levels: DataFrame
    stopped: DataFrame | None = None


def numbered(seeds: DataFrame) -> DataFrame:
    """(seed, block, bit) of distinct seeds, neighbours in order mostly in one block. Every task of the sort begins blocks of its own."""
    n = F.monotonically_increasing_id()
    ordered = stored(seeds.select("seed").where("seed is not null").distinct().orderBy("seed").withColumn("n", n), "seeds")
    return ordered.select("seed", F.shiftright("n", 6).alias("block"), F.col("n").bitwiseAND(WIDTH - 1).cast("int").alias("bit"))


def _set(bits: str, j: int) -> Column:
    return F.shiftright(bits, j).bitwiseAND(F.lit(1).cast("long"))


def counted(rows: DataFrame, seeds: DataFrame, *keys: str) -> DataFrame:
    """(seed, *keys, n): in how many of rows (block, bits, *keys) each source is set."""
    sums = rows.groupBy("block", *keys).agg(F.array(*(F.sum(_set("bits", j)) for j in range(WIDTH))).alias("sums"))
    each = sums.select("block", *keys, F.posexplode("sums").alias("bit", "n")).where("n > 0")
    return each.join(seeds, ["block", "bit"]).select("seed", *keys, "n")


def pairs(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows (block, bits, ...) once for each source that is set, as ``seed``."""
    bit = F.explode(F.expr(f"filter(sequence(0, {WIDTH - 1}), j -> (shiftright(bits, j) & 1) = 1)")).alias("bit")
    return rows.select("*", bit).join(seeds, ["block", "bit"]).drop("block", "bit", "bits")


def walk(edges: DataFrame, seeds: DataFrame, max_depth: int = 10_000, source: str = "from_id", target: str = "to_id", starts: bool = False, enough: int | None = None) -> Walk:
    """All nodes from which each seed (column ``seed``) can be reached along source -> target edges, by least depth.

    A seed itself belongs to its nodes only with ``starts``, and then at the
    length of its shortest cycle. With ``enough`` a seed goes no further after
    the level in which it has met more nodes than that: the levels before are
    whole, so its first ``enough`` by depth are right, and it is in ``stopped``
    if more was still ahead. Null ends are no edges, null seeds no seeds.
    """
    e = stored(edges.select(F.col(source).alias("id"), F.col(target).alias("at")).where("id is not null and at is not null").distinct(), "edges")
    seeds = numbered(seeds)
    one = F.expr("shiftleft(1L, bit)")
    first = stored(seeds.select("block", F.col("seed").alias("id"), one.alias("bits"), F.lit(0).alias("depth")), "level")
    levels, frontier, stopped = [first], first, None
    for depth in range(1, max_depth + 1):
        steps = frontier.select("block", F.col("id").alias("at"), "bits").join(e, "at")
        found = steps.groupBy("block", "id").agg(F.bit_or("bits").alias("met"))
        visited = [x for x in levels if starts is False or x is not first]
        if visited:
            seen = reduce(DataFrame.unionByName, visited).groupBy("block", "id").agg(F.bit_or("bits").alias("seen"))
            found = found.join(seen, ["block", "id"], "left")
        else:
            found = found.withColumn("seen", F.lit(None).cast("long"))
        new = F.col("met").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
        frontier = stored(found.select("block", "id", new.alias("bits"), F.lit(depth).alias("depth")).where("bits != 0"), "level")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if enough is not None:
            met = reduce(DataFrame.unionByName, levels[1:]).groupBy("block").agg(*(F.sum(_set("bits", j)).alias(f"n{j}") for j in range(WIDTH)))
            full = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.col(f"n{j}") > enough, F.expr(f"shiftleft(1L, {j})")).otherwise(F.lit(0).cast("long")) for j in range(WIDTH)))
            stopped = stored(met.select("block", full.alias("full")).where("full != 0"), "stopped")
            on = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("full", F.lit(0).cast("long"))))
            frontier = frontier.join(stopped, "block", "left").select("block", "id", on.alias("bits"), "depth").where("bits != 0")
        if len(levels) % KEPT == 0:  # keep the union short on long chains
            levels = [first, stored(reduce(DataFrame.unionByName, levels[1:]), "visited")]
    found = reduce(DataFrame.unionByName, levels).where("depth > 0")
    return Walk(seeds, found, stopped and stopped.withColumnRenamed("full", "bits"))
