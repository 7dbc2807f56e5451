"""The living system on Structured Streaming: change watching, debounce, activity, alerts, incremental facts."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import govern

DEBOUNCE = "15 seconds"
KEPT_EVENTS = 500


def watch_files(spark: SparkSession, root: str, schema: str = "rel_path string, ext string, modified timestamp, content string", max_files: int = 1000) -> DataFrame:
    """A stream of file facts that land below root as Parquet."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(root)


def debounced(changes: DataFrame, ts: str = "ts", gap: str = DEBOUNCE, late: str = "1 minute", key: str | None = None) -> DataFrame:
    """(start, end, n): bursts of changes with no pause of ``gap``; one re-analysis each. Works on a stream and on a table."""
    rows = changes.withWatermark(ts, late) if changes.isStreaming else changes
    groups = [F.session_window(ts, gap).alias("w"), *([key] if key else [])]
    return rows.groupBy(*groups).agg(F.count("*").alias("n")).select(*([key] if key else []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def activity_rates(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "1 hour", kind: str = "event_type") -> DataFrame:
    """(start, kind, n): events per window and type; later ones than ``late`` are dropped."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def once(events: DataFrame, ident: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events without repeats of an id within the watermark."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([ident])
    return events.dropDuplicates([ident])


def append_activity(events: DataFrame, path: str, checkpoint: str, interval: str | None = None):
    """Starts the append-only activity sink; without an interval it takes what there is and stops. compact_activity() applies the cap."""
    writer = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def compact_activity(spark: SparkSession, path: str, keep: int = KEPT_EVENTS) -> DataFrame:
    return govern.capped(spark.read.parquet(path), keep, ["ts", "event_id"])


def push(events: DataFrame, checkpoint: str, send: Callable[[DataFrame, int], None], interval: str | None = None):
    """Starts a sink that hands every batch with its id to ``send``. A batch is identified by its id, so nothing is lost when a log is capped and a repeat can be told."""

    def guarded(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            send(batch, batch_id)

    writer = events.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def dispatch_alerts(events: DataFrame, checkpoint: str, deliver: Callable[[list], None], drop: int = 10, most: int = 100, errors: list | None = None):
    """Starts alert delivery: all selected alerts of each batch, ``most`` to a call, from the driver. A delivery that fails is noted in ``errors`` and never ends the stream; without such a list it
    does end it, and the batch comes again. ``ledger.deliver_alerts`` sends from executors and keeps account."""

    def send(batch: DataFrame, batch_id: int) -> None:
        rows = govern.alerts(batch, drop).toLocalIterator()
        while chosen := list(islice(rows, most)):
            try:
                deliver(chosen)
            except Exception as e:
                if errors is None:
                    raise
                errors.append((batch_id, str(e)))

    return push(events, checkpoint, send)


def incremental(facts: DataFrame | None, files: DataFrame, changed: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Facts (with column file) after a change: those of unchanged files that still exist, and new ones of changed files. Equal to extract(files)."""
    fresh = extract(files.join(changed.select("rel_path").distinct(), "rel_path", "left_semi"))
    if facts is None:
        return fresh
    live = files.select(F.col("rel_path").alias("file")).distinct()
    stale = changed.select(F.col("rel_path").alias("file")).distinct()
    return facts.join(stale, "file", "left_anti").join(live, "file", "left_semi").unionByName(fresh)
