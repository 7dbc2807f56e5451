"""A stored inverted index: postings by term range with block maxima, in segments.

A segment holds the postings of some documents, sorted by (term, block, key), so
Parquet's own statistics skip what a term or prefix does not touch. A block is a
fixed share of the segment's documents by hash of their key; its header has, for
each term, how many documents and what bounds their weights: the largest count
and the least length. Segments are published as versions (sources.versions).

A changed document goes to a new segment with all its words; what older segments
say of it is void. Nothing old is written again, until ``compact``.

The best documents for a query are looked for block by block: headers give each
block a bound, those with the highest bounds are scored first, and only blocks
whose bound reaches the k-th score so far are read besides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import js_round
from ..sources.durable import TASK_ROWS, scans_of, stored
from ..sources.versions import open_version, publish
from .search import B, K1, query_tokens

#: Documents of a block, about; bytes of a Parquet row group, the unit that statistics skip.
BLOCK_DOCS, GROUP_BYTES = 1024, 1 << 20
#: Bytes of documents that one task cuts into words, about: text, key and DOC_BYTES for each, so that empty ones count too.
TASK_BYTES, DOC_BYTES = 8 << 20, 16
#: Bytes of counted words, as stored, that one task deals out by term: some two files of the tasks before.
SCAN_BYTES = 16 << 20
#: Blocks that are scored before the others are judged; blocks that a filter names one by one.
FIRST_BLOCKS, NAMED = 8, 1000


def words(content: Column) -> Column:
    """Lower-case words of three or more letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(content, F.lit(""))), F.lit("[a-z]{3,}"), 0)


def _segments(relations: dict[str, DataFrame]) -> list[int]:
    return sorted(int(n.removeprefix("sizes-")) for n in relations if n.startswith("sizes-"))


def add(docs: DataFrame, path: str, key: str = "rel_path", content: str = "content", gone: DataFrame | None = None, tokens: Column | None = None) -> int:
    """Indexes documents, new or changed, as one more segment, and forgets those of ``gone`` (column key); the segment's number.

    Of rows that repeat a key one counts: the one whose text sorts last. Null keys
    are no documents; a null text has no words. ``tokens``: an array of terms
    instead of the words of ``content``.

    Documents are dealt to tasks of about TASK_BYTES, postings to tasks of
    about TASK_ROWS, so that a task's memory doesn't grow with the input.
    """
    spark = docs.sparkSession
    old = open_version(spark, path) or {}
    segment = max(_segments(old), default=-1) + 1
    terms = words(F.col(content)) if tokens is None else F.coalesce(tokens, F.array().cast("array<string>"))
    docs = docs.where(F.col(key).isNotNull())
    held = F.octet_length(F.col(content)) if content in docs.columns else F.aggregate(F.array_compact(terms), F.lit(0), lambda n, t: n + F.octet_length(t) + 1)
    held = F.coalesce(held, F.lit(0)).cast("long") + F.octet_length(F.col(key).cast("string")) + DOC_BYTES
    parts = max(1, -(-(docs.agg(F.sum(held)).first()[0] or 0) // TASK_BYTES))
    base = docs.repartition(parts, F.col(key)).select(F.col(key).alias("key"), terms.alias("w")).groupBy("key").agg(F.max("w").alias("w"))
    # one more row for each document, without a term: it has a size even where it has no words
    each = base.select("key", F.size("w").cast("long").alias("size"), F.explode(F.array_append(F.array_compact("w"), F.lit(None).cast("string"))).alias("term"))
    each = stored(each.groupBy("key", "size", "term").agg(F.count("*").alias("tf")), "words")
    sized = each.where("term is null").select("key", "size", F.lit(False).alias("gone"))
    blocks = max(1, -(-sized.count() // BLOCK_DOCS))
    if gone is not None:
        dead = gone.select(F.col(key).alias("key")).where("key is not null").distinct().join(sized.select("key"), "key", "left_anti")
        sized = sized.unionByName(dead.select("key", F.lit(0).cast("long").alias("size"), F.lit(True).alias("gone")))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block")
    counts = each.where("term is not null").select("term", block, "key", "tf", "size")
    with scans_of(spark, SCAN_BYTES):
        tasks = max(1, -(-counts.count() // TASK_ROWS))
        ranged = counts.repartitionByRange(tasks, "term", "block")  # a block's documents of a term stay together
        headers = ranged.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("tf"), F.min("size").alias("size"))
        made = {f"postings-{segment}": ranged.sortWithinPartitions("term", "block", "key"), f"headers-{segment}": headers.sortWithinPartitions("term", "block"), f"sizes-{segment}": sized}
        publish(made, path, options={"parquet.block.size": str(GROUP_BYTES)})
    return segment


class Index:
    """An opened version of an index; what is published later is not seen."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.relations = spark, open_version(spark, path, version)
        if self.relations is None:
            raise ValueError(f"no index at {path}")
        self.segments = _segments(self.relations)

    def _all(self, name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.relations[f"{name}-{s}"].withColumn("segment", F.lit(s)) for s in self.segments))

    def void(self) -> DataFrame | None:
        """(key, segment): that a segment later than this one has the document."""
        if len(self.segments) == 1:
            return None
        later = [self.relations[f"sizes-{s}"].select("key", F.lit(s).alias("last")) for s in self.segments[1:]]
        return reduce(DataFrame.unionByName, later).groupBy("key").agg(F.max("last").alias("last"))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (key, segment, ...) of documents that no later segment has."""
        void = self.void()
        if void is None:
            return rows
        void = void.withColumnRenamed("key", "void_key")
        return rows.join(void, (F.col("key") == F.col("void_key")) & (F.col("segment") < F.col("last")), "left_anti")

    def documents(self) -> DataFrame:
        """(key, size) of all live documents."""
        return self._live(self._all("sizes")).where("not gone").select("key", "size")

    def _matching(self, name: str, tokens: list[str], exact: bool = False) -> DataFrame:
        """Rows of terms that begin with a token (or are one). The filter reaches the Parquet scan of each segment."""
        hit = reduce(lambda a, b: a | b, (F.col("term") == t if exact else F.col("term").startswith(t) for t in tokens))
        return self._all(name).where(hit)

    def lookup(self, query: str) -> DataFrame:
        """(term, n): the indexed words that begin with a token of the query, and how many live documents have each."""
        tokens = query_tokens(query)
        if not tokens:
            return self.spark.createDataFrame([], "term string, n long")
        return self._frequencies(tokens).where("n > 0")

    def _frequencies(self, tokens: list[str]) -> DataFrame:
        """(term, n) from the headers, less what is void: only documents of later segments are looked up among postings."""
        n = self._matching("headers", tokens).select("term", "n")
        if (void := self.void()) is not None:
            dead = self._matching("postings", tokens).join(void.withColumnRenamed("key", "void_key"), (F.col("key") == F.col("void_key")) & (F.col("segment") < F.col("last"))).groupBy("term").agg((-F.count("*")).alias("n"))
            n = n.unionByName(dead)
        return n.groupBy("term").agg(F.sum("n").alias("n"))

    def bm25(self, query: str, top: int = 10, k1: float = K1, b: float = B) -> DataFrame:
        """(key, score): the best documents, as search.bm25() of all live texts gives them: by score to one place, then by key."""
        tokens = query_tokens(query)
        if not tokens:
            return self.spark.createDataFrame([], "key string, score double")
        n, mean = self.documents().agg(F.count("*"), F.avg("size")).first()
        df = stored(self._frequencies(tokens).where("n > 0").withColumn("idf", F.log(1 + (F.lit(n) - F.col("n") + 0.5) / (F.col("n") + 0.5))).select("term", "idf"), "idf")
        weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.lit(mean)))
        bounds = stored(self._matching("headers", tokens).join(df, "term").groupBy("segment", "block").agg(F.sum(weight).alias("bound")), "bounds")

        def scored(blocks: list | DataFrame) -> DataFrame:
            rows = self._matching("postings", tokens)
            if isinstance(blocks, list):
                by: dict[int, list[int]] = {}
                for s, x in blocks:
                    by.setdefault(s, []).append(x)
                rows = rows.where(reduce(lambda a, c: a | c, ((F.col("segment") == s) & F.col("block").isin(x) for s, x in by.items()))) if by else rows.limit(0)
            else:
                rows = rows.join(blocks, ["segment", "block"], "left_semi")
            return self._live(rows).join(df, "term").groupBy("key").agg(js_round(F.sum(weight), 1).alias("score"))

        order = [F.desc("score"), "key"]
        first = [(r.segment, r.block) for r in bounds.orderBy(F.desc("bound"), "segment", "block").limit(FIRST_BLOCKS).collect()]
        best = stored(scored(first).orderBy(*order).limit(top), "best")
        least = best.agg(F.min("score")).first()[0] if best.count() == top else 0.0
        # rounding lifts a score by half a place at most; doubles are summed in any order
        open_ = bounds.where(F.col("bound") + 0.051 >= least)
        for s, x in first:
            open_ = open_.where(~((F.col("segment") == s) & (F.col("block") == x)))
        open_ = stored(open_.select("segment", "block"), "open")
        self.read = len(first) + (more := open_.count())
        rest = scored([tuple(r) for r in open_.collect()] if more <= NAMED else open_) if more else best.limit(0)
        return best.unionByName(rest).orderBy(*order).limit(top)

    def inverted(self, query: str, top: int = 10) -> DataFrame:
        """(key, score): 2 for each term equal to a token, 1 for each that begins with it, as search.inverted() over all terms gives it."""
        tokens = query_tokens(query)
        if not tokens:
            return self.spark.createDataFrame([], "key string, score long")
        points = sum((F.when(F.col("term") == q, 2).when(F.col("term").startswith(q), 1).otherwise(0) for q in tokens), F.lit(0))
        return self._live(self._matching("postings", tokens)).groupBy("key").agg(F.sum(points).alias("score")).orderBy(F.desc("score"), "key").limit(top)


def compact(spark: SparkSession, path: str, into: str) -> None:
    """All live postings as one segment of a new index: what later segments have made void is gone."""
    index = Index(spark, path)
    live = index._live(index._all("postings")).select("key", F.expr("array_repeat(term, cast(tf as int))").alias("t"))
    texts = live.groupBy("key").agg(F.flatten(F.collect_list("t")).alias("t"))
    docs = index.documents().select("key").join(texts, "key", "left")
    add(docs, into, "key", tokens=F.col("t"))
