"""Durable intermediate tables and distributed connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, about. Spark's own 64 MB times a batch's copies in the JVM, the pipe and numpy is a large part of an executor.
BATCH_BYTES = 8 << 20

_own_folder: list[str] = []


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most BATCH_BYTES from now on, however long its rows are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset and Spark runs in this one process (tests), a temporary
    one that goes with the process; a cluster has to name one.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="codestrata-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, so a
    lost executor costs a reread and never a rerun of what made the table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables from which everything that will be read has been stored itself.

    Spark deletes the shuffle files of a finished job once the driver's JVM
    collects what refers to them. It is asked to here: where a table goes
    because disk counts, those files of its making are the larger part.
    """
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def about(df: DataFrame, id_col: str, rows: int, n: int) -> DataFrame:
    """Of df's n rows about twice ``rows``, by the hash of their id: what is then ordered and cut to ``rows`` stays bounded on every partition."""
    share = min(1 << 30, (2 * rows << 30) // max(n, 1) + 1)
    return df.where(F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(1 << 30)) < share)


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0))).first())


def connected_components(edges: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (node, component = smallest node of it).

    Alternates the large-star and small-star steps: every step is a partial
    ``min`` per node and one join, so a node with very many links is combined
    before the shuffle. The minima are stored before they are joined: both sides
    of the join are then plain exchanges, whose large partitions Spark splits.
    Only nodes other than their component's smallest come back: a node that is
    absent is its own component. Null ends and self-links are ignored.
    """
    e = edges.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("v"), F.least(left, right).alias("u")).distinct()
    e = stored(e, "components")
    before = _summary(e)
    if not before[0]:
        return e.select(F.col("v").alias("node"), F.col("u").alias("component"))
    for _ in range(rounds):
        # large star: what is above a node moves to the least neighbour of that node
        both = e.select(F.col("v").alias("n"), F.col("u").alias("x")).unionByName(e.select(F.col("u").alias("n"), F.col("v").alias("x")))
        least = stored(both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m")), "least")
        large = e.select(F.col("u").alias("n"), F.col("v").alias("x")).join(least, "n").select(F.col("x").alias("v"), F.col("m").alias("u"))
        # nodes whose least neighbour lies below carry a link to it from the upper side, too
        large = stored(large.unionByName(least.where("m < n").select(F.col("n").alias("v"), F.col("m").alias("u"))).distinct(), "large")
        discard(least)
        # small star: a node and what is below it move to the least of them
        least = stored(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        if _summary(large) == before and least.count() == before[0]:  # every node has one link, and that to a node without: nothing can move any more
            break
        small = large.join(least, "v").where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        old, e = e, stored(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct(), "components")
        discard(old, large, least)
        before = _summary(e)
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component"))
