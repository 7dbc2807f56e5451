"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 12). DataFrame functions only.

A source's target is a share by weight of all that is mixed, at most CAP times
what the source has. As often as the target holds the whole source, the mix
takes it whole (epochs); what is left is a weighted sample without replacement:
every document draws an exponential variate, divided by its quality weight, and
documents are taken in that order until the budget is spent. The one at the edge
is taken in part, so a source takes its target to the word.

The order is never built as a whole. Keys fall into CELLS cells by their rank
under a standard exponential; sizes summed by source and cell (at most that many
rows a source, summed before the shuffle) tell in which cell the budget ends,
its documents are cut into CELLS finer cells, and only what lies in the last one
is sorted and summed one by one: about one row in CELLS**2 of a source. So a
source with a third of all rows is counted by all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Sources in order weigh this much, again and again.
WEIGHTS = (3.0, 1.0, 2.0)
#: What is mixed, as a multiple of all there is; what a source is repeated at most.
TOTAL, CAP = 1.5, 2.0
CELLS = 1 << 12
WORD = r"[^\x20\x09-\x0D]+"


def quality_weight(text: Column) -> Column:
    """0.05 to 1: the share of letters among what isn't white space, to the fourth power. A text without any weighs least."""
    seen = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.coalesce(F.greatest(F.lit(0.05), F.pow(letters / F.nullif(seen, F.lit(0)), F.lit(4.0))), F.lit(0.05))


def exponential(seed: int, *columns: str) -> Column:
    """A standard exponential variate from 52 bits of an md5: the same in every run, and in SQL."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in columns]
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52)))


def _cell(key: Column) -> tuple[Column, Column]:
    """(cell, finer cell) of a key: both rise with it."""
    place = (1 - F.exp(-key)) * F.lit(float(CELLS))
    cell = F.least(F.floor(place), F.lit(CELLS - 1)).cast("int")
    return cell, F.least(F.floor((place - cell) * CELLS), F.lit(CELLS - 1)).cast("int")


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with their place (from 0) in code point order, null last: ranges are sorted apart, their counts summed."""
    ordered = stored(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    task = F.shiftright("at", 33)
    starts = ordered.groupBy(task.alias("task")).agg(F.count("*").alias("n"))  # a row for each task of the sort
    starts = starts.withColumn("start", F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    return ordered.withColumn("task", task).join(starts.drop("n"), "task").withColumn("place", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("task", "at", "start")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """(source, source_size, target): ``total`` of all sizes shared by weight, no source above ``cap`` times its size.

    What is above is shared again among the others, by weight, until none is: a
    round is one sum over the sources. A source of no words has the target 0.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = stored(numbered(sources).select("source", "source_size", weight.alias("weight"), (cap * F.col("source_size")).alias("most")), "weights")
    level, held = None, F.lit(False)
    while True:
        all_, full, open_, n = s.agg(
            F.sum("source_size"), F.coalesce(F.sum(F.when(held, F.col("most"))), F.lit(0.0)), F.sum(F.when(~held, F.col("weight"))), F.count(F.when(held, 1))
        ).first()
        if open_ is None or level is not None and n == before:  # noqa: F821
            break
        level, before = (total * all_ - full) / open_, n
        held = F.col("most") < F.col("weight") * level
    share = F.lit(0.0) if level is None else F.least(F.col("most"), F.col("weight") * level)
    return s.select("source", "source_size", F.when(held, F.col("most")).otherwise(share).alias("target"))


def _end(sums: DataFrame, by: str) -> DataFrame:
    """(source, by, before): the row of each source in which its budget ``left`` ends; ``before`` is what comes first. sums has n_words by source and ``by``."""
    w = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.withColumn("through", F.sum("n_words").over(w)).where("through - n_words < left and left <= through").withColumn("before", F.col("through") - F.col("n_words")).drop("through")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP, seed: int = 12, quality: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) and (source, key, epochs) of every document.

    ``taken``: the words that the mix takes of it, repeats counted: ``epochs``
    times all and, if it is drawn, once more. A null text has no words and is
    taken never; a null source is a source of its own, the last. Any length is
    counted whole. Rows alike in id, source, key and size are drawn together: at
    the edge each gets an equal part, to the nearest word. Equal keys go by id,
    null ids first. Other columns are not read. No rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    d = docs.select("doc_id", "source", size.alias("size"), (exponential(seed, "doc_id") / (quality_weight(text) if quality is None else quality)).alias("key"))
    cell, fine = _cell(F.col("key"))
    d = stored(d.withColumn("cell", cell).withColumn("fine", fine), "sizes")

    cells = stored(d.groupBy("source", "cell").agg(F.sum("size").alias("n_words")), "cells")
    goal = targets(cells.groupBy("source").agg(F.sum("n_words").alias("source_size")), weights, total, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("left", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    goal = stored(goal, "goals").withColumnRenamed("source", "s")

    same = F.col("source").eqNullSafe(F.col("s"))
    first = _end(cells.join(goal.where("left > 0").select("s", "left"), same).drop("s"), "cell")
    first = first.select(F.col("source").alias("s"), F.col("cell").alias("c"), (F.col("left") - F.col("before")).alias("left"))
    inner = stored(d.where("size > 0").join(first, same & (F.col("cell") == F.col("c"))).drop("s", "c"), "edge")
    second = _end(inner.groupBy("source", "fine", "left").agg(F.sum("size").alias("n_words")), "fine")
    second = second.select(F.col("source").alias("s"), F.col("fine").alias("f"), (F.col("left") - F.col("before")).alias("rest"))
    last = inner.join(second, same & (F.col("fine") == F.col("f"))).groupBy("source", "cell", "fine", "key", "doc_id", "size", "rest").agg(F.count("*").alias("n"))
    last = last.withColumn("n_words", F.col("n") * F.col("size")).withColumnRenamed("rest", "left")
    order = F.struct("key", "doc_id", "size")
    last = _end(last.withColumn("order", order), "order")
    edge = last.select(F.col("source").alias("s"), F.struct("cell", "fine", "order").alias("edge"), F.round((F.col("left") - F.col("before")) / F.col("n")).cast("long").alias("part"))

    # stored, so that the join with all documents stands between plain exchanges, whose large partitions Spark splits
    goal = stored(goal.join(edge.withColumnRenamed("s", "e"), F.col("s").eqNullSafe(F.col("e")), "left").drop("e"), "edges")
    place = F.struct("cell", "fine", order.alias("order"))
    drawn = F.when(F.col("left") <= 0, 0).when(place < F.col("edge"), F.col("size")).when(place == F.col("edge"), F.col("part")).otherwise(0)
    taken = F.when(F.col("size") > 0, F.col("epochs") * F.col("size") + drawn).otherwise(0).cast("long")
    return d.join(goal, same).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "key", "epochs")
