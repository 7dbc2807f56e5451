"""Deliveries with a ledger: what is to be sent is written before, what came of it after.

    <path>/intents/<batch>    (call, event, payload, tries): what is to be sent, grouped into calls
    <path>/outcomes/<batch>   (..., ok, error): what each call gave
    <path>/failed/<batch>     what has used up its tries, kept for whoever looks after it
    <path>/open/<batch>       what is to be tried again with the next batch; its presence ends the batch

Calls are made by the tasks that hold them; no event passes the driver. A batch
that is run again, after a restart, takes its intents as they were written and
sends nothing whose outcome is known. A call that was cut off before its outcome
was written is made again under the same key, by which a receiver tells it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import govern
from ..sources.durable import stored
from ..sources.versions import _Files
from .live import push

INTENT = "call string, event string, payload string, tries int"
OUTCOME = INTENT + ", ok boolean, error string"


class Ledger:
    """deliver(payloads, key): sends the JSON texts of one call, and raises if it can't. Runs on executors."""

    def __init__(self, spark: SparkSession, path: str, deliver: Callable[[list[str], str], None] | None = None, most: int = 100, tries: int = 5):
        self.spark, self.path, self.deliver, self.most, self.tries = spark, path.rstrip("/"), deliver, most, tries
        self.files = _Files(spark, self.path)

    def _names(self, table: str) -> list[str]:
        """The batches of a table that are written whole."""
        return [n for n in self.files.names(table) if "_SUCCESS" in self.files.names(f"{table}/{n}")]

    def _read(self, table: str, batch: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}/{batch}")

    def _write(self, rows: DataFrame, table: str, batch: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/{batch}")

    def _all(self, table: str) -> DataFrame:
        names = self._names(table)
        return self.spark.read.schema(OUTCOME).parquet(*(f"{self.path}/{table}/{n}" for n in names)) if names else self.spark.createDataFrame([], OUTCOME)

    def sent(self) -> DataFrame:
        """(event, payload, call): what was taken by a receiver."""
        return self._all("outcomes").where("ok").select("event", "payload", "call")

    def failed(self) -> DataFrame:
        """What has used up its tries, with the last error."""
        return self._all("failed")

    def open(self) -> DataFrame:
        """What waits for its next try."""
        done = self._names("open")
        return self._read("open", done[-1], OUTCOME) if done else self.spark.createDataFrame([], OUTCOME)

    def take(self, events: DataFrame | None, batch: str, key: str = "event_id") -> None:
        """One batch: the events (each with all its columns as JSON; equal rows once) and what is still open, in calls of at most ``most``."""
        if batch in self._names("open"):
            return
        if batch not in self._names("intents"):
            before = [n for n in self._names("open") if n < batch]
            waiting = self._read("open", before[-1], OUTCOME).select("event", "payload", "tries") if before else None
            fresh = events and events.select(F.col(key).cast("string").alias("event"), F.to_json(F.struct("*")).alias("payload")).distinct().withColumn("tries", F.lit(0))
            todo = waiting.unionByName(fresh) if waiting is not None and fresh is not None else waiting if fresh is None else fresh
            if todo is None:
                return
            placed = stored(todo.orderBy("event", "payload").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("n")), "calls")
            call = F.concat_ws("-", F.lit(batch), F.col("part").cast("string"), F.floor(F.col("n") / self.most).cast("string"))
            self._write(placed.select(call.alias("call"), "event", "payload", (F.col("tries") + 1).alias("tries")), "intents", batch)
        if batch not in self._names("outcomes"):
            deliver = self.deliver

            def send(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
                try:
                    deliver(list(rows["payload"]), key[0])
                    return rows.assign(ok=True, error=None)
                except Exception as e:  # a receiver's failure is an outcome like any other
                    return rows.assign(ok=False, error=f"{type(e).__name__}: {e}")

            intents = self._read("intents", batch, INTENT)
            self._write(intents.groupBy("call").applyInPandas(send, OUTCOME), "outcomes", batch)
        lost = self._read("outcomes", batch, OUTCOME).where("not ok")
        self._write(lost.where(F.col("tries") >= self.tries), "failed", batch)
        self._write(lost.where(F.col("tries") < self.tries), "open", batch)

    def retry(self) -> bool:
        """Tries what is open once more, without a batch of new events; whether anything was open."""
        done = self._names("open")
        if not done or self.open().isEmpty():
            return False
        batch, _, k = done[-1].partition("r")
        self.take(None, f"{batch}r{int(k or 0) + 1:04}")
        return True


def deliver_alerts(events: DataFrame, checkpoint: str, ledger: str, deliver: Callable[[list[str], str], None], drop: int = 10, most: int = 100, tries: int = 5, interval: str | None = None):
    """Starts alert delivery through a ledger. Every selected alert of the stream is sent, kept as open, or kept as failed, whatever the length of any log."""

    def send(batch: DataFrame, batch_id: int) -> None:
        Ledger(batch.sparkSession, ledger, deliver, most, tries).take(govern.alerts(batch, drop), f"{batch_id:010}")

    return push(events, checkpoint, send, interval)


def outstanding(spark: SparkSession, ledger: str) -> Iterator[str]:
    """Batches whose intents are written and whose outcomes are not: cut off, or under way."""
    book = Ledger(spark, ledger)
    done = set(book._names("open"))
    return (n for n in book._names("intents") if n not in done)
