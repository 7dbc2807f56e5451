"""Bursts of changes that end by a timer: a quiet period fires although no later change comes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .live import push

RUN = "key string, start long, end long, n long"


def _merged(runs: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Runs (start, end, n) without a pause of more than ``gap`` inside, put together where none is between them."""
    out: list[tuple[int, int, int]] = []
    for start, end, n in sorted(runs):
        if out and start - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(end, out[-1][1]), n + out[-1][2])
        else:
            out.append((start, end, n))
    return out


def quiet_bursts(changes: DataFrame, gap: float, ts: str = "ts", key: str | None = None, patience: float | None = None) -> DataFrame:
    """(key, start, end, n) of a stream of changes: bursts without a pause of more than ``gap`` seconds, as ``debounced`` gives them of a table.

    A burst is given out when a later one of its key begins, or, by a timer,
    when nothing of its key has come for ``patience`` seconds (``gap`` unless
    given) of the clock; its state is gone then. end is the last change and the
    gap. Changes are put together to runs by the tasks that read them, so a key
    that holds most of a batch is a few rows for the task that keeps its state.
    A change that comes after its burst was given out is a burst of its own.
    Null times are no changes; null keys are one key.
    """
    width = int(gap * 1_000_000)
    wait = max(1, int((gap if patience is None else patience) * 1000))
    rows = changes.select((F.col(key) if key else F.lit("")).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).where("at is not null")

    def collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values(["key", "at"], kind="stable")
            new = (b["key"] != b["key"].shift()) | (b["at"] - b["at"].shift() > width)
            yield b.groupby(new.cumsum()).agg(key=("key", "first"), start=("at", "min"), end=("at", "max"), n=("at", "size"))

    def keep(ident: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        runs = [tuple(state.get)] if state.exists else []
        if state.hasTimedOut:
            state.remove()
            over = runs
        else:
            for b in batches:
                runs = _merged(runs + list(zip(b["start"].tolist(), b["end"].tolist(), b["n"].tolist())), width)
            *over, last = runs
            state.update(last)
            state.setTimeoutDuration(wait)
        yield pd.DataFrame([(ident[0], *r) for r in over], columns=["key", "start", "end", "n"])

    bursts = rows.mapInPandas(collapse, RUN).groupBy("key").applyInPandasWithState(keep, RUN, "start long, end long, n long", "append", "ProcessingTimeTimeout")
    return bursts.select("key", F.timestamp_micros("start").alias("start"), F.timestamp_micros(F.col("end") + width).alias("end"), "n")


def reanalyse(changes: DataFrame, checkpoint: str, run: Callable[[DataFrame, int], None], gap: float = 15, interval: str = "1 second", **how):
    """Starts re-analysis: ``run`` gets the bursts that have ended. One run at a time: what ends meanwhile is the next one's."""
    return push(quiet_bursts(changes, gap, **how), checkpoint, run, interval)


def settled(query, seconds: float = 300) -> None:
    """Waits until a stream has no input and keeps no burst any more, and stops it."""
    import time

    until, seen = time.time() + seconds, False
    try:
        while time.time() < until:
            if query.exception():
                raise query.exception()
            p = query.lastProgress
            if p:
                seen = seen or p["numInputRows"] > 0 or any(s["numRowsTotal"] > 0 for s in p["stateOperators"])
                if seen and not p["numInputRows"] and all(s["numRowsTotal"] == 0 for s in p["stateOperators"]):
                    return
            time.sleep(0.2)
        raise TimeoutError(f"bursts are still open after {seconds} seconds")
    finally:
        query.stop()
