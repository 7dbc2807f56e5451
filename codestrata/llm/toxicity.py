"""Toxicity by FTRL-proximal logistic regression over hashed n-grams (operator 3).

Features are the distinct hashed words, word pairs and skip pairs of a whole
text. FTRL keeps a learning rate for each coordinate and an L1 term that leaves
most weights at exactly zero, so the model that is broadcast is a short list of
(coordinate, weight), however many n-grams the corpus has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .hashing import Words, blocks, mix
from .shared import about, bounded

BITS = 22
#: Labelled rows that the model is fitted on, at most: those with the least hash of their id.
FIT_ROWS = 16_000
#: Features of all of these together, at most, in the same order: 256 MB in the one task that fits.
FIT_FEATURES = 1 << 26
EPOCHS = 10
#: A strong L1 keeps coordinates that only chance ties to a label at zero. A toxic row counts TOXIC_WEIGHT times, being the rarer kind.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 8.0, 0.01
TOXIC_WEIGHT = 3.0
THRESHOLD = 0.7

_U = np.uint64


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct coordinates of each text, end to end, and where each text's begin.

    Words are runs of ASCII letters, digits and bytes over 127, A-Z folded.
    Coordinate 0 is the bias and no n-gram's.
    """
    w = Words(texts, fold=True, letters=True)
    h, of = w.hash, w.text
    grams, owners = [h], [of]
    for far, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > far:
            same = of[far:] == of[:-far]
            grams.append(mix(h[:-far] * _U(salt) + h[far:])[same])
            owners.append(of[far:][same])
    g = (mix(np.concatenate(grams)) % _U((1 << BITS) - 1)).astype(np.int64) + 1
    key = np.unique((np.concatenate(owners) << BITS) | g)
    return key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(len(texts) + 1) << BITS)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, texts in blocks(batch.column(2).to_pylist()):
            g, first = features(texts)
            cut = slice(begin, begin + len(texts))
            rows = [g[first[i] : first[i + 1]].astype("<u4").tobytes() for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0)[cut], batch.column(1)[cut], pa.array(rows, pa.binary())], names=["place", "toxic", "features"])


def fit(samples: list[tuple[int, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (label, coordinates) in the given order; the coordinates with a weight, and their weights."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(z[at]) <= L1] = 0
        return w

    for _ in range(epochs):
        for label, at in samples:
            at = np.concatenate([[0], at.astype(np.int64)])
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (TOXIC_WEIGHT if label else 1.0)
            root = np.sqrt(n[at])
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - root) / ALPHA * w
            n[at] = grown
    every = np.arange(1 << BITS)
    w = weights(every)
    return every[w != 0], w[w != 0]


def _samples(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(label, coordinates) row by row, as long as they have no more than ``most`` features in all; a row that would exceed it is left out."""
    for batch in batches:
        for label, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if len(raw) // 4 > most:
                continue
            most -= len(raw) // 4
            yield label, np.frombuffer(raw, "<u4")


def _fit(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    at, w = fit(list(_samples(batches, most)))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["coordinate", "weight"])


def _score(batches: Iterator[pa.RecordBatch], sent, text_at: int | None) -> Iterator[pa.RecordBatch]:
    """Adds a score to the first column: a row whose field text_at is the text, or an id with the text beside it."""
    at, w = sent.value
    dense = np.zeros(1 << BITS)
    dense[at] = w
    for batch in batches:
        column = batch.column(1) if text_at is None else batch.column(0).field(text_at).cast(pa.binary())
        for begin, texts in blocks(column.to_pylist()):
            g, first = features(texts)
            owner = np.repeat(np.arange(len(texts)), np.diff(first))
            total = dense[0] + np.bincount(owner, weights=dense[g], minlength=len(texts))
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[begin : begin + len(texts)], pa.array(score)], names=[batch.schema.names[0], "score"])


def held_out(doc_id) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Weights from at most ``rows`` labelled documents that are not held out, with ``fit_features`` features in all at most. Null labels are ignored; a document labelled twice counts as toxic if any label says so."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
    usable = about(usable, "doc_id", rows, usable.count())
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    known = texts.join(F.broadcast(chosen), "doc_id")  # at most `rows` rows of three numbers
    ready = known.select("place", "toxic", "text").mapInArrow(_extract, "place long, toxic int, features binary")
    model = ready.repartitionByRange(1, "place").sortWithinPartitions("place", "toxic", "features").mapInArrow(lambda it: _fit(it, fit_features), "coordinate long, weight double").toArrow()
    return np.asarray(model.column("coordinate")).astype(np.int64), np.asarray(model.column("weight")).astype(np.float64)


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, carry: bool = False, fit_features: int = FIT_FEATURES) -> DataFrame:
    """One row per document: doc_id, held_out, score in [0, 1], predicted (1 if score >= 0.7).

    With carry, the document's own row is there too, as the struct ``row``.
    Only the text enters a score. Null or empty text: the bias alone. Texts of
    any length are scored whole. Without any usable label every score is 0.5; of the ``rows`` labelled documents that are
    learned from, one that would exceed ``fit_features`` with those before it is left out. Repeated rows get equal scores; a null
    id is not held out. Other columns are ignored. No rows give no rows.
    """
    sent = bounded(docs.sparkSession).sparkContext.broadcast(train(docs, labels, rows, fit_features))  # at most 2**BITS pairs
    if carry:
        base = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
        at = docs.columns.index("text")
        schema = StructType([base.schema["row"], StructField("score", DoubleType())])
        scored = base.mapInArrow(lambda it: _score(it, sent, at), schema).withColumn("doc_id", F.col("row.doc_id").cast("long"))
    else:
        base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        scored = base.mapInArrow(lambda it: _score(it, sent, None), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *["row"] * carry)
