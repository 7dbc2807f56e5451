"""Tables that outlive the executors that made them."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task of a large aggregate holds, about.
TASK_ROWS = 500_000

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset and Spark runs in this one process (tests), a temporary folder that goes with it; a cluster has to name one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="codestrata-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Cuts lineage by writing df to the shared folder and reading it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys) -> DataFrame:
    """df dealt by keys to tasks of about TASK_ROWS, where the session's number of partitions would give each of them more."""
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


@contextlib.contextmanager
def scans_of(spark: SparkSession, most: int):
    """Within it, a task of the session's scans reads about ``most`` bytes of files, or what the session says if that is less.

    A task that deals its rows to more than 200 others keeps them in memory until it has read them all.
    """
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, min(most, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)
