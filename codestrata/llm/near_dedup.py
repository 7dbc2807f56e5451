"""MinHash near-dedup by fast similarity sketching (operator 8).

1. Sketch. Round i throws every shingle into a hashed bin with value
   (i, hash); a bin keeps what its first round brought, least hash first. After
   SIZE rounds of random bins, round SIZE + j fills bin j, so every coordinate
   is filled, and equal coordinates estimate the Jaccard similarity with
   Chernoff-type bounds. Long texts need one to three rounds, not SIZE hashes.
2. Equal sets collapse to the document with the smallest id.
3. Banding: BANDS bands of ROWS coordinates. At similarity 0.8 a pair misses
   all bands with probability (1 - 0.8**4)**32 = 5e-8.
4. Exact verification on full sets, star-wise: in a bucket each set is compared
   with the bucket's centre only. What is linked gets one label, and from here
   on only links between labels are looked for: each merging works on the few
   labels that new links touch, never again on all links.
5. What is still open, members of one bucket with different labels, goes to an
   exact prefix filter, which has no cap and loses nothing: sets of similarity
   0.8 share one of their rarest shingles within the pair's prefix lengths.
   There, too, stars come first; then the remaining pairs, which by then differ
   in nearly all such shingles. Nothing open ends the search.

Minima per bucket are stored before they are joined: both sides of the join are
plain exchanges, and Spark splits those where a bucket or shingle is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, blocks, mix
from .shared import bounded, connected_components, discard, stored

SHINGLE = 4
BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
#: Shingles are ordered by the counts of 2**BINS hashed bins.
BINS = 20
#: Longs of the bit filter that spares the texts nobody asks for their shuffle.
FILTER_WORDS = 1 << 18

SKETCH = "doc_id long, text_key long, n_shingles long, set_id binary, bands array<long>"
SETS = "rep long, n long, shingles binary, compared boolean, central boolean"

_U = np.uint64


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's begin."""
    w = Words(texts, fold=True)
    count = np.diff(w.first)
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    of = np.repeat(np.arange(len(texts)), n)
    start = w.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    h = w.ranges(start, start + np.minimum(words, count[of])) if len(of) else np.zeros(0, np.uint64)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=len(texts)))]).astype(np.int64)


def sketches(shingles: np.ndarray, first: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Fast similarity sketches, a row of ``size`` filled coordinates for each set (unfilled only if it is empty)."""
    n = len(first) - 1
    empty = np.iinfo(np.uint64).max
    out = np.full(n * size, empty, dtype=np.uint64)
    of = np.repeat(np.arange(n), np.diff(first))
    h = shingles
    for i in range(2 * size):
        if not len(h):
            break
        x = mix(h + _U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = of * size + ((x >> _U(40)) % _U(size)).astype(np.int64) if i < size else of * size + (i - size)
        found = np.full_like(out, empty) if n * size < len(h) else None
        value = (_U(i) << _U(40)) | (x & _U((1 << 40) - 1))
        free = out[place] == empty
        if found is None:
            np.minimum.at(out, place[free], value[free])
        else:
            np.minimum.at(found, place[free], value[free])
            out = np.minimum(out, found)
        done = (out.reshape(n, size) != empty).all(axis=1)
        stays = ~done[of]
        h, of = h[stays], of[stays]
    return out.reshape(n, size)


def _sketch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        for begin, texts in blocks(batch.column(2).to_pylist()):
            h, first = shingle_sets(texts, words)
            s = mix(sketches(h, first)).reshape(len(texts), BANDS, ROWS)
            bands = s[:, :, 0]
            for r in range(1, ROWS):
                bands = mix(bands * _U(31) + s[:, :, r])
            bands = mix(bands + salt).view(np.int64)
            n = np.diff(first)
            ids = [hashlib.md5(h[first[i] : first[i + 1]].tobytes()).digest() if n[i] else None for i in range(len(texts))]
            offsets = pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32())
            cut = slice(begin, begin + len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0)[cut], batch.column(1)[cut], pa.array(n), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel()))], names=[f.split()[0] for f in SKETCH.split(", ")])


def _full(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, texts in blocks(batch.column(1).to_pylist()):
            h, first = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays([batch.column(0)[begin : begin + len(texts)], pa.array(np.diff(first)), pa.array([h[first[i] : first[i + 1]].tobytes() for i in range(len(texts))], pa.binary()), *(batch.column(c)[begin : begin + len(texts)] for c in (2, 3))], names=["rep", "n", "shingles", "compared", "central"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(x) + len(y)
            cut = both - len(np.unique(np.concatenate([x, y])))
            keep.append(100 * cut >= percent * (both - cut))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """The label pairs (a, b) of those of pairs (x_rep, y_rep, a, b) whose full sets, in sets and others, are similar enough. Sizes too far apart are never compared."""
    near = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    left = pairs.join(sets.select(F.col("rep").alias("x_rep"), "n", F.col("shingles").alias("x")), "x_rep")
    right = others.select(F.col("rep").alias("y_rep"), F.col("n").alias("m"), F.col("shingles").alias("y"))
    return stored(left.join(right, "y_rep").where(near).select("a", "b", "x", "y").mapInArrow(lambda it: _confirm(it, percent), "a long, b long"), "links")


def _composed(first: DataFrame | None, then: DataFrame) -> DataFrame:
    """One map of labels for two, one after the other. What ``then`` moves are labels that ``first`` leaves, or has made."""
    if first is None:
        return then
    moved = then.select(F.col("node").alias("component"), F.col("component").alias("last"))
    both = first.join(moved, "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    return stored(both.unionByName(then), "labels")


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows with the labels that theirs have become."""
    now = merged.select(F.col("node").alias("label"), "component")
    return rows.join(now, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")


def _mixed(rows: DataFrame) -> DataFrame:
    """Buckets with more than one label, and a centre: the member with the greatest label (and rep)."""
    ends = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max(F.struct("label", "rep")).alias("top"))
    return stored(ends.where("low < top.label").select("bucket", F.col("top.label").alias("b"), F.col("top.rep").alias("y_rep")), "mixed")


def _bins(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ _U(0x2545F4914F6CDD1D)) >> _U(64 - BINS)).astype(np.int64)


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int, sent) -> Iterator[pa.RecordBatch]:
    """The shingles of a set that a partner of at least its own similarity must share one of, rarest first."""
    often = sent.value
    for batch in batches:
        out = []
        for n, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            h = np.frombuffer(raw, np.uint64)
            out.append(h[np.lexsort((h, often[_bins(h)]))[: n - -(-percent * n // 100) + 1]].view(np.int64))
        ends = np.cumsum([0, *map(len, out)])
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*out, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), found], names=["rep", "label", "n", "prefix"])


def _flat(prefixes: DataFrame) -> DataFrame:
    """A row for each shingle of a prefix, with its place."""
    return prefixes.select("rep", "label", "n", F.posexplode("prefix").alias("place", "bucket"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(1 << BINS, np.int64)
    for batch in batches:
        for _, texts in blocks(batch.column(0).to_pylist()):
            n += np.bincount(_bins(np.frombuffer(b"".join(texts), np.uint64)), minlength=1 << BINS)
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used])], names=["bin", "n"])


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall in each of 2**BINS hashed bins: a fixed size, summed over every set. It only orders shingles; any order gives the same links."""
    n = np.zeros(1 << BINS, np.uint32)
    found = sets.select("shingles").mapInArrow(_count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    n[np.asarray(found.column("bin"))] = np.minimum(np.asarray(found.column("n")), 2**32 - 1)
    return n


def _asked_for(base: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of base whose (doc_id, text_key) keys may hold: all that it does, and by chance a few more.

    A bit filter of FILTER_WORDS longs, joined by word: a broadcast of that many
    rows at most. With far more keys than bits it lets all pass, which costs a
    shuffle and changes nothing.
    """
    h = F.xxhash64("doc_id", "text_key")
    word, bit = F.pmod(F.shiftright(h, 6), F.lit(FILTER_WORDS)), h.bitwiseAND(63).cast("int")
    on = keys.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held = F.call_function("getbit", F.col("bits"), F.col("bit")) == 1
    return base.withColumn("word", word).withColumn("bit", bit).join(F.broadcast(on), "word").where(held).drop("word", "bit", "bits")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs outside ``\\x20\\x09-\\x0D`` with A-Z lower-cased; a set holds
    the distinct shingles of ``words`` words, or the whole sequence if it is
    shorter. Documents are linked where 100 * intersection >= percent * union
    of full sets; component_id is the smallest id reachable and kept says
    whether it is the document's own.

    Null or empty text, or one without words: n_shingles 0, linked with nothing.
    Texts of any length are compared whole. Rows that repeat an id are one node
    of the graph with the links of all of them, and each keeps its row. A null
    id has component_id null and is kept. Other columns are ignored. An empty
    table gives no rows.
    """
    spark = bounded(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    sketch = stored(base.mapInArrow(lambda it: _sketch(it, words), SKETCH), "sketches")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("set_id").agg(F.min("doc_id").alias("rep")), "classes")
    member = stored(full.join(classes, "set_id").select("doc_id", "text_key", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")), "members")

    alone = stored(sketch.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")), "alone")
    discard(sketch, classes)

    banded = member.where("bands is not null").select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = stored(banded.groupBy("bucket").agg(F.min("rep").alias("b"), F.max("rep").alias("other")).where("b < other").select("bucket", "b"), "centres")
    buckets = stored(banded.join(shared, "bucket"), "buckets")
    centres = buckets.where("rep = b").select("b", F.col("n").alias("m")).distinct()
    pairs = stored(buckets.where("rep != b").select("rep", "n", "b").distinct().join(centres, "b").where(f"100 * least(n, m) >= {percent} * greatest(n, m)").select("rep", "b").distinct(), "pairs")
    ends = pairs.select("rep", F.lit(True).alias("compared"), F.lit(False).alias("central")).unionByName(pairs.select(F.col("b").alias("rep"), F.lit(False).alias("compared"), F.lit(True).alias("central")))
    others = buckets.select("rep", F.lit(False).alias("compared"), F.lit(False).alias("central"))
    roles = ends.unionByName(others).groupBy("rep").agg(F.max("compared").alias("compared"), F.max("central").alias("central"))
    keys = stored(member.where("bands is not null").join(roles, "rep").select("doc_id", "text_key", "compared", "central").distinct(), "live")
    # repeated rows meet once, where the join has put them
    live = _asked_for(base, keys).join(keys, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text", "compared", "central")
    sets = stored(live.mapInArrow(lambda it: _full(it, words), SETS), "sets")
    discard(keys, shared)

    merged: DataFrame | None = None  # what labels have become

    def merge(links: DataFrame) -> DataFrame | None:
        nonlocal merged
        if links.isEmpty():
            return None
        now = connected_components(links, "a", "b")
        merged = _composed(merged, now)
        return now

    links = _links(pairs.select(F.col("rep").alias("x_rep"), F.col("b").alias("y_rep"), F.col("rep").alias("a"), "b"), sets.where("compared"), sets.where("central"), percent)
    several = stored(member.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("b < a"), "several")
    if not several.isEmpty():  # ids with different texts tie the classes of all of them
        links = links.unionByName(member.join(several.select("doc_id", "b"), "doc_id").where("rep != b").select(F.col("rep").alias("a"), "b").distinct())
    rows = buckets.select("bucket", "rep", F.col("rep").alias("label"))
    if (now := merge(links)) is not None:
        rows = stored(_relabelled(rows, now), "labelled")
        discard(buckets)

    mixed = _mixed(rows)
    if not mixed.isEmpty():
        open_reps = rows.join(mixed.select("bucket"), "bucket").select("rep", "label").distinct()
        left = stored(sets.join(open_reps, "rep").select("rep", "label", "n", "shingles"), "left")
        discard(sets)  # what is open is in left
        sent = spark.sparkContext.broadcast(_frequencies(left))  # 2**BINS numbers
        prefix = stored(left.mapInArrow(lambda it: _prefixes(it, percent, sent), "rep long, label long, n long, prefix array<long>"), "prefixes")
        mixed = _mixed(_flat(prefix))
    if not mixed.isEmpty():
        star = _flat(prefix).join(mixed, "bucket").where("label != b").select(F.col("rep").alias("x_rep"), "y_rep", F.col("label").alias("a"), "b").distinct()
        if (now := merge(_links(star, left, left, percent))) is not None:
            old, prefix = prefix, stored(_relabelled(prefix, now), "prefixes")  # a row for each set
            discard(old)
        # pairs of a bucket's commonest label with the others, and of the others: never those within that label
        labels = _flat(prefix).groupBy("bucket", "label").agg(F.count("*").alias("rows")).groupBy("bucket").agg(F.max(F.struct("rows", "label")).alias("most"), F.count("*").alias("labels"))
        common = stored(labels.where("labels > 1").select("bucket", F.col("most.label").alias("common")), "common")
        sides = stored(_flat(prefix).join(common, "bucket"), "sides")
        x, y = (sides.select("bucket", *(F.col(c).alias(f"{s}_{c}") for c in ("rep", "label", "n", "place", "common"))) for s in "xy")
        need = f"ceil({percent} * (x_n + y_n) / {100 + percent})"
        cross = x.where("x_label != x_common").join(y, "bucket").where(f"x_label != y_label and (y_label = y_common or x_rep > y_rep) and 100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n) and x_place <= x_n - {need} and y_place <= y_n - {need}")
        merge(_links(cross.select("x_rep", "y_rep", F.col("x_label").alias("a"), F.col("y_label").alias("b")).distinct(), left, left, percent))

    out = member.select("doc_id", "n_shingles", F.col("rep").alias("label"))
    if merged is not None:
        out = _relabelled(out, merged)
    out = out.select("doc_id", "n_shingles", F.col("label").alias("component_id"))
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    return out.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept)
