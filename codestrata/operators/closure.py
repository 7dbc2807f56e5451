"""A stored closure that follows changes of the graph: what depends on each watched node, without a new walk.

Removed edges first take back, along the edges as they were, everything that may
have rested on them; then what still has another way, and what added edges bring,
comes back by one semi-naive walk along the edges as they are. Both walks move
bit sets of 64 watched nodes each, and go only where something changes.

    <path>/data/<unique>/<relation>/bucket=<n>    Parquet, never written again
    <path>/manifests/00000002.json                where each bucket of each relation lies

Relations are cut into buckets by a hash of the node by which they are looked
up. A level of a walk reads the buckets of its nodes, an update writes those
buckets in which a row changes; the others are taken over by name. A version is
there once its manifest has got its name.

Rows of ``into`` say what the version that wrote them did with the edge (``op``:
1 added, -1 removed, null left alone); removed ones are not read as edges. So
one exchange finds what changes and writes it.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.durable import TASK_ROWS, stored
from ..sources.versions import _Files, manifest
from .walks import KEPT, counted, numbered, pairs

BUCKETS = 256
#: Files that a bucket may be written as at once, more where these would have more than TASK_ROWS rows.
SPLITS = 4

#: Relations by name: schema, the column whose hash gives the bucket, the columns that tell rows apart. Edges lie there by either end.
STORED = {
    "into": ("from_id string, to_id string, op int", "to_id", ("from_id", "to_id")),
    "out": ("from_id string, to_id string", "from_id", ("from_id", "to_id")),
    "reach": ("block long, id string, bits long, base long", "id", ("block", "id")),
}


def _zero() -> Column:
    return F.lit(0).cast("long")


def _or_zero(c: str) -> Column:
    return F.coalesce(F.col(c), _zero())


def _without(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def _edges(df: DataFrame) -> DataFrame:
    return df.select("from_id", "to_id").where("from_id is not null and to_id is not null")


def _merged(levels: list[DataFrame], name: str) -> DataFrame:
    return reduce(DataFrame.unionByName, levels).groupBy("block", "id").agg(F.bit_or("bits").alias(name))


def _whole(levels: list[DataFrame], name: str) -> DataFrame:
    """All levels of a walk; one alone has no row twice."""
    return levels[0].withColumnRenamed("bits", name) if len(levels) == 1 else stored(_merged(levels, name), name)


class Closure:
    """A version (the last) of a stored closure. ``renewed``: buckets of each relation that the update leading to it has written."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        found = manifest(spark, path, version)
        if found is None:
            raise ValueError(f"no closure of that version at {path}")
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.buckets, self.places, self.renewed = found["version"], found["buckets"], found["places"], found["renewed"]
        self.seeds = spark.read.schema("seed string, block long, bit int").parquet(f"{self.path}/{found['seeds']}")
        self._seeds = found["seeds"]

    @classmethod
    def build(cls, edges: DataFrame, seeds: DataFrame, path: str, buckets: int = BUCKETS) -> Closure:
        """Closure of edges (from_id, to_id) for the watched nodes in column ``seed``. Null ends are no edges, null seeds no seeds; repeats count once.

        A full build is an update of an empty graph.
        """
        spark, at = edges.sparkSession, f"data/{uuid.uuid4().hex}/seeds"
        root = path.rstrip("/")
        numbered(seeds).write.parquet(f"{root}/{at}")
        empty = cls.__new__(cls)
        empty.spark, empty.path, empty.version, empty.buckets, empty._seeds = spark, root, 0, buckets, at
        empty.places, empty.renewed = {name: {} for name in STORED}, {}
        empty.seeds = spark.read.schema("seed string, block long, bit int").parquet(f"{root}/{at}")
        own = F.expr("shiftleft(1L, bit)")
        start = empty.seeds.select("block", F.col("seed").alias("id"), own.alias("bits"), own.alias("base"))
        empty.places["reach"] = empty._written("reach", empty._dealt("reach", start, start.count()))
        return empty.update(edges, edges.limit(0))

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, buckets=None) -> DataFrame:
        held = self.places[name]
        paths = [f"{self.path}/{held[b]}" for b in (held if buckets is None else map(str, buckets)) if b in held]
        rows = self._rows(name, paths)
        return rows.where("op is null or op > 0").drop("op") if name == "into" else rows

    def _rows(self, name: str, paths: list[str]) -> DataFrame:
        schema = STORED[name][0]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _touched(self, rows: DataFrame, column: str) -> list[int]:
        """At most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self._bucket(column)).distinct().collect())

    def _near(self, name: str, rows: DataFrame, column: str) -> DataFrame:
        """The relation's buckets in which values of a column of rows fall."""
        return self._read(name, self._touched(rows, column))

    def _dealt(self, name: str, rows: DataFrame, n: int) -> DataFrame:
        """About n rows with columns bucket and part, dealt by these to tasks of about TASK_ROWS. What is grouped by these and more is not dealt again."""
        _, key, apart = STORED[name]
        splits, tasks = max(SPLITS, -(-n // (self.buckets * TASK_ROWS))), -(-n // TASK_ROWS)
        cells = rows.withColumn("bucket", self._bucket(key)).withColumn("part", F.pmod(F.xxhash64(*apart), F.lit(splits)))
        more = tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return cells.repartition(tasks, "bucket", "part") if more else cells.repartition("bucket", "part")

    def _written(self, name: str, cells: DataFrame) -> dict[str, str]:
        """Places of the buckets that dealt rows have."""
        at = f"data/{uuid.uuid4().hex}/{name}"
        cells.drop("part").write.partitionBy("bucket").parquet(f"{self.path}/{at}")
        made = (n.partition("=")[2] for n in _Files(self.spark, self.path).names(at) if n.startswith("bucket="))
        return {b: f"{at}/bucket={b}" for b in made}

    def _replaced(self, name: str, buckets: list[int], made: dict[str, str]) -> dict[str, str]:
        """Places of the relation after buckets were replaced by those made."""
        new = set(map(str, buckets))
        return {b: p for b, p in self.places[name].items() if b not in new} | {b: p for b, p in made.items() if b in new}

    def _step(self, level: DataFrame) -> DataFrame:
        """(block, id, met): where the level's nodes lead. Those to which no edge leads are left out before edges are dealt."""
        edges = self._near("into", level, "id")
        inner = stored(edges.select(F.col("to_id").alias("id")).distinct(), "inner")
        front = stored(level.join(inner, "id", "left_semi"), "front")
        if front.isEmpty():
            return front.withColumnRenamed("bits", "met")
        steps = front.withColumnRenamed("id", "to_id").join(edges, "to_id")
        return steps.groupBy("block", F.col("from_id").alias("id")).agg(F.bit_or("bits").alias("met"))

    def _lost(self, gone: DataFrame) -> DataFrame:
        """(block, id, lost): what may have rested on edges that are gone, along the edges as they were; what a watched node is by itself stays."""
        if gone.isEmpty():
            return self.spark.createDataFrame([], "block long, id string, lost long")
        ends = self._near("reach", gone, "to_id").select("block", F.col("id").alias("to_id"), "bits")
        found = gone.join(ends, "to_id").groupBy("block", F.col("from_id").alias("id")).agg(F.bit_or("bits").alias("met"))
        levels: list[DataFrame] = []
        while True:
            found = stored(found, "found")
            held = found.join(self._near("reach", found, "id"), ["block", "id"])
            new = _without(F.col("met").bitwiseAND(F.col("bits")), F.col("base"))
            if levels:
                held, new = held.join(_merged(levels, "seen"), ["block", "id"], "left"), _without(new, _or_zero("seen"))
            level = stored(held.select("block", "id", new.alias("bits")).where("bits != 0"), "lost")
            if level.isEmpty():
                break
            levels = [*levels, level] if len(levels) < KEPT else [stored(_merged([*levels, level], "bits"), "lost")]
            found = self._step(level)
        return _whole(levels or [level], "lost")

    def _won(self, new: DataFrame, lost: DataFrame, before: Closure, gone: DataFrame) -> DataFrame:
        """(block, id, won): what comes by added edges, and what was taken back and has another way; self holds the edges as they are now.

        Whatever added edges bring comes with them, also to nodes that have lost it, so other ways are those along edges that were there before.
        """

        def now(rows: DataFrame, column: str) -> DataFrame:
            left = self._near("reach", rows, column).join(lost, ["block", "id"], "left")
            return left.select("block", F.col("id").alias("to_id"), _without(F.col("bits"), _or_zero("lost")).alias("bits")).where("bits != 0")

        came = new.join(now(new, "to_id"), "to_id").select("block", "from_id", "bits")
        if not lost.isEmpty():
            ways = lost.withColumnRenamed("id", "from_id").join(before._near("out", lost, "id"), "from_id")
            ways = stored(ways.join(gone, ["from_id", "to_id"], "left_anti"), "ways")
            came = came.unionByName(ways.join(now(ways, "to_id"), ["block", "to_id"]).select("block", "from_id", F.col("bits").bitwiseAND(F.col("lost")).alias("bits")))
        found = came.groupBy("block", F.col("from_id").alias("id")).agg(F.bit_or("bits").alias("met"))
        levels: list[DataFrame] = []
        while True:
            found = stored(found, "found")
            held = found.join(self._near("reach", found, "id"), ["block", "id"], "left").join(lost, ["block", "id"], "left")
            fresh = _without(F.col("met"), _without(_or_zero("bits"), _or_zero("lost")))
            if levels:
                held, fresh = held.join(_merged(levels, "seen"), ["block", "id"], "left"), _without(fresh, _or_zero("seen"))
            level = stored(held.select("block", "id", fresh.alias("bits")).where("bits != 0"), "won")
            if level.isEmpty():
                break
            levels = [*levels, level] if len(levels) < KEPT else [stored(_merged([*levels, level], "bits"), "won")]
            found = self._step(level)
        return _whole(levels or [level], "won")

    def update(self, added: DataFrame, removed: DataFrame) -> Closure:
        """The version after edges were removed and added; equal to a full build of the graph as it is then.

        An edge on both lists is there afterwards. Removing what is not there and
        adding what is there change nothing.
        """
        asked = stored(_edges(added).withColumn("op", F.lit(1)).unionByName(_edges(removed).withColumn("op", F.lit(-1))), "asked")
        there = self._near("into", asked, "to_id").withColumn("op", F.lit(0))
        rows = self._dealt("into", asked.unionByName(there), asked.count() + there.count())
        rows = rows.groupBy("bucket", "part", "from_id", "to_id").agg(F.max(F.when(F.col("op") != 0, F.col("op"))).alias("asked"), F.max(F.col("op") == 0).alias("there"))
        op = F.when((F.col("asked") == 1) & ~F.col("there"), 1).when((F.col("asked") == -1) & F.col("there"), -1)
        made = self._written("into", rows.select("bucket", "part", "from_id", "to_id", op.alias("op")).where("there or op = 1"))
        changed = self._rows("into", [f"{self.path}/{p}" for p in made.values()]).where("op is not null")
        new, gone = changed.where("op = 1").drop("op"), changed.where("op = -1").drop("op")
        renewed = {"into": self._touched(changed, "to_id"), "out": self._touched(changed, "from_id")}
        after = Closure.__new__(Closure)
        after.__dict__.update(self.__dict__, places=self.places | {"into": self._replaced("into", renewed["into"], made)})
        if buckets := renewed["out"]:
            there = self._read("out", buckets).withColumn("op", F.lit(0))
            rows = self._dealt("out", changed.unionByName(there), changed.count() + there.count())
            if not gone.isEmpty():
                rows = rows.groupBy("bucket", "part", "from_id", "to_id").agg(F.min("op").alias("op")).where("op >= 0")
            after.places["out"] = self._replaced("out", buckets, self._written("out", rows.drop("op")))
        lost = self._lost(gone)
        won = after._won(new, lost, self, gone)
        none = lambda c: _zero().alias(c)
        parts = [lost.select("block", "id", none("bits"), none("base"), "lost", none("won")), won.select("block", "id", none("bits"), none("base"), none("lost"), "won")]
        buckets = renewed["reach"] = self._touched(parts[0].unionByName(parts[1]), "id")
        if buckets:
            all_of = reduce(DataFrame.unionByName, parts, self._read("reach", buckets).select("*", none("lost"), none("won")))
            all_of = self._dealt("reach", all_of, all_of.count()).groupBy("bucket", "part", "block", "id").agg(*(F.bit_or(c).alias(c) for c in ("bits", "base", "lost", "won")))
            rows = all_of.select("bucket", "part", "block", "id", _without(F.col("bits"), F.col("lost")).bitwiseOR(F.col("won")).alias("bits"), "base").where("bits != 0")
            after.places["reach"] = self._replaced("reach", buckets, self._written("reach", rows))
        after.renewed = {name: len(b) for name, b in renewed.items()}
        after._publish(self.version + 1)
        return after

    def _publish(self, version: int) -> None:
        files, own = _Files(self.spark, self.path), f"pending/{uuid.uuid4().hex}.json"
        self.version = version
        files.write(own, json.dumps({"version": version, "buckets": self.buckets, "places": self.places, "renewed": self.renewed, "seeds": self._seeds}))
        if not files.rename(own, f"manifests/{version:08}.json"):
            files.delete(own)
            raise RuntimeError(f"someone else has published version {version} at {self.path}: update that one")

    def _bits(self) -> DataFrame:
        """A watched node is none of its own dependents, on a cycle neither."""
        return self._read("reach").select("block", "id", _without(F.col("bits"), F.col("base")).alias("bits")).where("bits != 0")

    def dependents(self) -> DataFrame:
        """(seed, id): all nodes from which a watched node can be reached."""
        return pairs(self._bits(), self.seeds).select("seed", "id")

    def counts(self) -> DataFrame:
        """(seed, n): the number of dependents; watched nodes without any are left out."""
        return counted(self._bits(), self.seeds)
