"""Substring dedup by prefix-partitioned suffix trees (operator 9).

A window of 50 words is a suffix cut at depth 50, the depth that matters. Of
the 26 places in a window where a prefix of 25 words begins, the one with the
least hash is its *anchor*: equal windows have equal anchors at equal places.
Consecutive windows with one anchor form a *stretch* of 50 to 75 words, whose
suffixes all go to one subtree.

1. Stretches are partitioned by the 25 words at their anchor. A prefix seen in
   one document only has no repeat below it; it is pruned after one partial
   aggregation.
2. Equal stretches are one path of the tree: a prefix as long as the stretch
   splits them off, and one partial minimum per path gives the smallest document
   that has it. All others lose the stretch. Thousands of copies are one row
   from here on.
3. A prefix with 2 to GROUP_ROWS different stretches is a group that fits in
   memory. A task takes group after group, sorts its suffixes word by word,
   and computes the longest common prefixes of neighbours; intervals of these
   that reach 50 are the deep internal nodes. A node whose smallest document lies
   before another of its documents is a repeat, and neighbouring repeats of a
   stretch merge to a maximal one, which is removed.
4. A prefix with more stretches is lengthened to the 50 words of each window.
   A subtree below so long a prefix is a single node, of which nothing but the
   smallest document is needed: again one partial minimum, and no group is ever
   gathered.

Minima are stored, then joined by plain exchanges, whose large partitions Spark
splits. Suffixes in a task are compared by 64 bits a word; paths and lengthened
prefixes by two independent 64-bit hashes, 128 bits in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .hashing import Words, blocks
from .shared import bounded, discard, stored

WINDOW = 50
#: Different stretches below a prefix that one task sorts at once: about 600 bytes of word hashes each.
GROUP_ROWS = 1024

STRETCH = "doc_id long, text_key long, prefix long, stretch long, first long, windows int, anchor int"
SUFFIX = "doc_id long, text_key long, prefix long, node long, first long, windows int, anchor int, words binary"
RANGE = "doc_id long, text_key long, first long, stop long"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each place the leftmost place of the least value among the next width (by doubling)."""
    value, place, span = values.copy(), np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        right = value[step:] < value[:-step]
        place[:-step] = np.where(right, place[step:], place[:-step])
        value[:-step] = np.minimum(value[step:], value[:-step])
        span += step
    return place


def _stretches(batches: Iterator[pa.RecordBatch], window: int, prefix: int) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in STRETCH.split(", ")]
    for batch in batches:
        ids, keys = (np.asarray(batch.column(i)) for i in (0, 1))
        for begin, texts in blocks(batch.column(2).to_pylist()):
            w = Words(texts)
            n = len(w)
            if n < window:
                continue
            at = np.arange(n - prefix + 1)
            gram = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
            gram[: len(at)] = w.ranges(at, at + prefix)
            p = np.arange(n - window + 1)
            p = p[w.text[: len(p)] == w.text[window - 1 :]]
            if not len(p):
                continue
            anchor = _least(gram, window - prefix + 1)[p]
            new = np.ones(len(p), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
            s = np.flatnonzero(new)
            count = np.diff(np.append(s, len(p)))
            first, doc = p[s], w.text[p[s]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[begin + doc], keys[begin + doc], _signed(gram[anchor[s]]), _signed(w.ranges(first, first + count - 1 + window)), first - w.first[doc], count.astype(np.int32), (anchor[s] - first).astype(np.int32))], names=names)


def _suffixes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The word hashes of the given stretches of each text; of those below a prefix with too many, each window's hash instead."""
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in SUFFIX.split(", "))])
    for batch in batches:
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = batch.column(3).to_pylist()
        for begin, texts in blocks(batch.column(2).to_pylist()):
            w, out = Words(texts), []
            for i in range(len(texts)):
                who = ids[begin + i], keys[begin + i]
                for x in rows[begin + i]:
                    p = int(w.first[i]) + x["first"]
                    if x["large"]:
                        at = np.arange(p, p + x["windows"])
                        out += [(*who, x["prefix"], node, x["first"] + k, 1, 0, None) for k, node in enumerate(_signed(w.ranges(at, at + window)).tolist())]
                    else:
                        out.append((*who, x["prefix"], None, x["first"], x["windows"], x["anchor"], w.hash[p : p + x["windows"] + window - 1].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def deep_nodes(group: np.ndarray, doc: np.ndarray, anchor: np.ndarray, windows: np.ndarray, words: list[bytes], window: int) -> np.ndarray:
    """For each stretch (row) and window of it whether a smaller document has that window, in the same group.

    Suffixes that begin equally far before their anchors are sorted word by
    word; the longest common prefixes of neighbours give the tree's nodes.
    """
    prefix = window // 2
    ahead = window - prefix
    n = len(group)
    text = np.zeros((n, ahead + window), np.uint64)
    size = windows + window - 1
    row = np.repeat(np.arange(n), size)
    text[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + (ahead - anchor)[row]] = np.frombuffer(b"".join(words), np.uint64)
    found = np.zeros((n, ahead + 1), dtype=bool)
    for before in range(ahead + 1):
        at = anchor - before
        rows = np.flatnonzero((at >= 0) & (at < windows))
        if len(rows) < 2:
            continue
        suffix = text[rows, ahead - before : ahead - before + window]
        free = [*range(before), *range(before + prefix, window)]  # the anchor's own words are equal within a group
        order = np.lexsort((*(suffix[:, c] for c in reversed(free)), group[rows]))
        suffix, rows = suffix[order], rows[order]
        differs = suffix[1:] != suffix[:-1]
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), window)
        common[group[rows[1:]] != group[rows[:-1]]] = 0
        starts = np.flatnonzero(np.append(True, common < window))
        least = np.repeat(np.minimum.reduceat(doc[rows], starts), np.diff(np.append(starts, len(rows))))
        found[rows, at[rows]] = least < doc[rows]
    return found


def _grow(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The maximal repeats of whole groups, which come in order. What is held back is the last, unfinished group."""

    def repeats(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows < 2:
            return
        ids, keys, group, first, windows, anchor = (np.asarray(rows.column(c)) for c in ("doc_id", "text_key", "prefix", "first", "windows", "anchor"))
        found = deep_nodes(group, ids, anchor, windows, rows.column("words").to_pylist(), window)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], keys[row], first[row] + begin, first[row] + end - 1 + window)], names=[f.split()[0] for f in RANGE.split(", ")])

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        group = np.asarray(rows.column("prefix"))
        done = int(np.searchsorted(group, group[-1])) if len(group) else 0
        yield from repeats(rows.slice(0, done))
        held = rows.slice(done)
    if held is not None:
        yield from repeats(held)


def _cut(batches: Iterator[pa.RecordBatch], text_at: int | None) -> Iterator[pa.RecordBatch]:
    """Cuts the ranges out of the text, which is the first column or the field text_at of it."""
    for batch in batches:
        own = batch.column(0)
        texts = own if text_at is None else own.field(text_at).cast(pa.binary())
        n_words, n_removed, kept, digest = [], [], [], []
        for text, spans in zip(texts.to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = (text or b"").split()
            n_words.append(len(words))
            if spans:
                gone = np.zeros(len(words) + 1, dtype=np.int32)
                np.add.at(gone, [x["first"] for x in spans], 1)
                np.add.at(gone, [x["stop"] for x in spans], -1)
                stays = np.cumsum(gone[:-1]) == 0
                words = [words[i] for i in np.flatnonzero(stays)]
            n_removed.append(n_words[-1] - len(words))
            left = b" ".join(words)
            kept.append(left)
            digest.append(hashlib.sha256(left).hexdigest())
        made = [pa.array(x, t) for x, t in ((n_words, pa.int64()), (n_removed, pa.int64()), (kept, pa.binary()), (digest, pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(2) if text_at is None else own, *made], names=["doc_id" if text_at is None else "row", "n_words", "n_removed", "kept", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept, kept_sha256.

    Words are runs outside ``\\x20\\x09-\\x0D``. Each word covered by a window of
    ``window`` words that also starts in a document with a smaller id is
    removed; ``kept`` holds the rest, joined by one space. With carry, the
    document's own row is there in place of its id, as the struct ``row``.

    Null or empty text: no words, kept is ''. Texts of any length are compared
    whole. Rows with one id are one document to the comparison (none is smaller
    than the other) yet each keeps a result row of its own. A null id is never
    smaller and never removed from. Other columns are ignored. An empty table
    gives no rows.
    """
    bounded(docs.sparkSession)
    prefix = window // 2
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    known = base.where("doc_id is not null")

    stretches = stored(known.mapInArrow(lambda it: _stretches(it, window, prefix), STRETCH), "stretches")
    shared = stored(stretches.groupBy("prefix").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("prefix"), "prefixes")
    live = stored(stretches.join(shared, "prefix"), "live")
    discard(stretches, shared)

    paths = stored(live.groupBy("prefix", "stretch").agg(F.min("doc_id").alias("least")), "paths")
    forks = stored(paths.groupBy("prefix").agg(F.count("*").alias("paths")).where("paths > 1").select("prefix"), "forks")
    marked = stored(live.join(paths, ["prefix", "stretch"]).select("doc_id", "text_key", "prefix", "first", "windows", "anchor", (F.col("doc_id") > F.col("least")).alias("copy")), "marked")
    discard(live, paths)
    whole = marked.where("copy").select("doc_id", "text_key", "first", (F.col("first") + F.col("windows") + (window - 1)).alias("stop"))

    # rows that repeat a document meet once; rows are counted, as a document may have one path many times
    alone = stored(marked.where("not copy").join(forks, "prefix").select("doc_id", "text_key", "prefix", "first", "windows", "anchor").distinct(), "alone")
    sizes = stored(alone.groupBy("prefix").agg((F.count("*") > group_rows).alias("large")), "sizes")
    opened = alone.join(sizes, "prefix").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("prefix", "first", "windows", "anchor", "large")).alias("spans"))
    texts = known.join(opened, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", "text", "spans")
    suffixes = stored(texts.mapInArrow(lambda it: _suffixes(it, window), SUFFIX), "suffixes")
    groups = suffixes.where("words is not null").drop("node").repartition("prefix").sortWithinPartitions("prefix")
    parts = stored(groups.mapInArrow(lambda it: _grow(it, window), RANGE), "repeats")
    long = suffixes.where("words is null")
    if not long.isEmpty():
        nodes = stored(long.groupBy("prefix", "node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("prefix", "node", "least"), "nodes")
        parts = parts.unionByName(long.join(nodes, ["prefix", "node"]).where("doc_id > least").select("doc_id", "text_key", "first", (F.col("first") + window).alias("stop")))

    ranges = whole.unionByName(parts).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "stop")).alias("ranges"))
    join = lambda df: df.join(ranges, ["doc_id", "text_key"], "left")
    result = "n_words long, n_removed long, kept binary, kept_sha256 string"
    if carry:
        whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
        at = docs.columns.index(text_col)
        schema = StructType([whole.schema["row"], *StructType.fromDDL(result).fields])
        out = join(whole).select("row", "ranges").mapInArrow(lambda it: _cut(it, at), schema)
    else:
        out = join(base).select("text", "ranges", "doc_id").mapInArrow(lambda it: _cut(it, None), f"doc_id long, {result}")
    return out.withColumn("kept", F.col("kept").cast("string"))
