"""From raw documents to packed sequences: quality rules, toxicity, near-dedup,
substring dedup, best-fit packing. Each stage works on all its predecessor kept.

``run`` writes every stage as Parquet under the folder in
``spark.checkpoint.dir`` and rereads it: a lost executor costs a reread.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.near_dedup import near_duplicates
from codestrata.llm.packing import pack
from codestrata.llm.quality import judge, ledger
from codestrata.llm.shared import shared_folder, stored
from codestrata.llm.substring_dedup import remove_repeats
from codestrata.llm.toxicity import score_toxicity

TOKENIZER = "byte_bpe_50k.json"
#: Words of a shingle in the near_dedup stage; op8's contract has four.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps.

    A null or empty text, and one of few words, goes; texts of any length are
    judged whole, each row by itself, so repeated rows and null ids are judged
    like any others. Ties don't occur. Other columns stay. No rows give no rows.
    """
    return judge(ledger(docs, carry=True)).where("kept").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labelled documents of this input, doesn't find toxic.

    Without a usable label, with a null text or a null id nothing is found toxic
    but by its words. Repeated rows score alike. Other columns stay. No rows give
    no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels, carry=True).where("predicted = 0").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Only the removed ids are joined, and stored first, so that a join without a
    shuffle is chosen where they are few. Rows that repeat an id are one
    document: all of them stay or go. A null id, and a text without words, is
    nobody's copy and stays. Other columns stay. No rows give no rows.
    """
    gone = stored(near_duplicates(docs, words=SHINGLE).where("not kept").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that a document with a smaller id has. One that loses nothing stays as it is.

    Rows that repeat an id are no source for each other; each keeps its own
    text. A null id is never a source and loses nothing; a null text stays null.
    Other columns stay, but n_chars follows the text. No rows give no rows.
    """
    left = remove_repeats(docs, carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    row = F.col("row").withField("text", text).withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return left.select(row.alias("row")).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens.

    A null or empty text is its end id alone; a long one has as many pieces as it
    needs. Repeated rows and null ids are packed like others. No rows give no rows.
    """
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: Toxicity is learned and packing is a plan: SQL can't express them. tests/llm compares the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir. Every stage takes all rows that the one before kept, whatever they hold (see there)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
