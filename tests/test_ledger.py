"""Deliveries over restarts, with receivers that fail."""

import json
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codestrata.streaming.ledger import Ledger, deliver_alerts, outstanding


def alerts(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("event_id"), F.lit("new-risk").alias("type"), F.lit(0).alias("change"), F.lit("critical").alias("severity"))


def receiver(folder, fails):
    """Notes every accepted call as a file of its own; ``fails(key, folder)`` says which it refuses."""

    def deliver(payloads, key):
        if fails(key, folder):
            raise RuntimeError("no line")
        (Path(folder) / f"{key}.txt").write_text("\n".join(payloads))

    return deliver


def accepted(folder):
    return Counter(json.loads(line)["event_id"] for f in Path(folder).glob("*.txt") for line in f.read_text().splitlines())


def source(spark, tmp_path):
    return spark.readStream.schema(alerts(spark, 0, 1).schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def test_more_events_than_any_log_keeps(spark, tmp_path):
    """1,200 alerts come between two runs; each reaches the receiver once, also over a restart and with a failing receiver."""
    (tmp_path / "out").mkdir()
    out, book = str(tmp_path / "out"), f"file://{tmp_path}/ledger"
    refuses = lambda key, folder: key.split("-")[0] == "0000000000" and zlib.crc32(key.encode()) % 2 == 0
    for low, high in ((0, 300), (300, 1500), (1500, 1501)):
        alerts(spark, low, high).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        deliver_alerts(source(spark, tmp_path), f"{tmp_path}/c", book, receiver(out, refuses), most=40).awaitTermination()
    assert accepted(out) == Counter(range(1501))
    ledger = Ledger(spark, book)
    assert ledger.open().isEmpty() and ledger.failed().isEmpty() and sorted(int(r.event) for r in ledger.sent().collect()) == list(range(1501))
    assert not list(outstanding(spark, book))


def test_a_batch_that_was_cut_off_sends_only_what_is_open(spark, tmp_path):
    (tmp_path / "out").mkdir()
    out, book = str(tmp_path / "out"), f"file://{tmp_path}/ledger"
    ledger = Ledger(spark, book, receiver(out, lambda key, folder: False), most=10)
    write, asked = ledger._write, []
    ledger._write = lambda rows, table, batch: write(rows, table, batch) if table in ("intents", "outcomes") else asked.append(table) or 1 / 0
    with pytest.raises(ZeroDivisionError):
        ledger.take(alerts(spark, 0, 55), "0000000000")
    assert asked == ["failed"] and list(outstanding(spark, book)) == ["0000000000"]
    again = Ledger(spark, book, receiver(out, lambda key, folder: 1 / 0), most=10)
    again.take(alerts(spark, 0, 55), "0000000000")  # what was sent is known: the receiver, which is broken now, isn't called
    assert accepted(out) == Counter(range(55)) and again.open().isEmpty() and not list(outstanding(spark, book))
    again.take(alerts(spark, 0, 55), "0000000000")
    assert again.sent().count() == 55


def test_tries_end_and_what_failed_is_kept(spark, tmp_path):
    (tmp_path / "out").mkdir()
    book = f"file://{tmp_path}/ledger"
    ledger = Ledger(spark, book, receiver(str(tmp_path / "out"), lambda key, folder: True), most=3, tries=3)
    rows = alerts(spark, 0, 7).unionByName(alerts(spark, 0, 2)).unionByName(alerts(spark, 0, 1).withColumn("event_id", F.lit(None).cast("long")))
    ledger.take(rows, "0000000007")
    assert {r.tries for r in ledger.open().collect()} == {1}
    rounds = 0
    while ledger.retry():
        rounds += 1
    kept = ledger.failed().collect()
    assert rounds == 2 and len(kept) == 8 and {r.error for r in kept} == {"RuntimeError: no line"} and ledger.sent().isEmpty()
    assert {r.call.split("-")[0] for r in kept} == {"0000000007r0002"}
    assert not ledger.retry() and not Ledger(spark, f"file://{tmp_path}/none").retry()
