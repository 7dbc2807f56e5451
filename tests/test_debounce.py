"""Bursts by timer against the batch form."""

import random

from pyspark.sql import functions as F

from codestrata.streaming import live
from codestrata.streaming.debounce import _merged, quiet_bursts, reanalyse, settled

SCHEMA = "k string, t long"


def changes(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("k", F.timestamp_seconds("t").alias("ts"))


def test_runs_are_put_together():
    rng = random.Random(1)
    for _ in range(50):
        times = [rng.randrange(200) for _ in range(rng.randrange(1, 40))]
        whole = _merged([(t, t, 1) for t in times], 5)
        cut = rng.randrange(len(times))
        assert _merged(_merged([(t, t, 1) for t in times[:cut]], 5) + _merged([(t, t, 1) for t in times[cut:]], 5), 5) == whole
        assert sum(n for *_, n in whole) == len(times) and all(b[0] - a[1] > 5 for a, b in zip(whole, whole[1:]))


def test_last_burst_fires_without_a_later_change(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(3000)) for _ in range(400)] + [("a", None), ("b", 7), ("b", 7)]
    changes(spark, rows).repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(changes(spark, []).schema).parquet(f"file://{tmp_path}/in")
    got, ids = [], []

    def run(bursts, batch_id):
        ids.append(batch_id)
        got.extend((r.key, r.start, r.end, r.n) for r in bursts.collect())

    settled(reanalyse(stream, f"{tmp_path}/c", run, gap=15, key="k", patience=0.5))
    want = live.debounced(changes(spark, [r for r in rows if r[1] is not None]), gap="15 seconds", key="k").collect()
    # a table's sessions end where two changes are exactly one gap apart, so the bursts are compared with plain ones
    plain = [(k, *b) for k in ("a", "b", "c", None) for b in _merged([(t, t, 1) for x, t in rows if x == k and t is not None], 15)]
    assert sorted((str(k), int(s.timestamp()), int(e.timestamp()) - 15, n) for k, s, e, n in got) == sorted((str(k), *b) for k, *b in plain)
    assert len(set(ids)) > 1 and abs(len(want) - len(got)) < 20


def test_state_is_gone_and_a_restart_goes_on(spark, tmp_path):
    got = []
    for rows in ([("a", 1), ("a", 2)], [("a", 100), ("a", 300)], []):
        if rows:
            changes(spark, rows).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(changes(spark, []).schema).parquet(f"file://{tmp_path}/in")
        q = reanalyse(stream, f"{tmp_path}/c", lambda b, i: got.extend((int(r.start.timestamp()), r.n) for r in b.collect()), gap=15, key="k", patience=0.5)
        if rows:
            settled(q)
        else:
            q.awaitTermination(4)
            q.stop()
    assert got == [(1, 2), (100, 1), (300, 1)]


def test_no_key(spark, tmp_path):
    changes(spark, [("a", 1), ("b", 2)]).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(changes(spark, []).schema).parquet(f"file://{tmp_path}/in")
    q = quiet_bursts(stream, 15, patience=0.2).writeStream.format("memory").queryName("bursts_no_key").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    settled(q)
    assert [r.n for r in spark.table("bursts_no_key").collect()] == [2]
