"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Whole tables and whole texts; odd rows as the operator's docstring says."""
    from .html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 1024 tokens. Whole tables and whole texts; odd rows as the operator's docstring says."""
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from labels that are not held out. Whole tables and whole texts; odd rows as the operator's docstring says."""
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url. Whole tables and whole texts; odd rows as the operator's docstring says."""
    from .url_filter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict of every document. Whole tables and whole texts; odd rows as the operator's docstring says."""
    from .quality import judge, ledger

    return judge(ledger(_table(spark, sf_dir, "documents")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices in all documents. Whole tables and whole texts; odd rows as the operator's docstring says."""
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each whose id is divisible by 20. Whole tables and whole texts; odd rows as the operator's docstring says."""
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under near copies, by four-word shingles. Whole tables and whole texts; odd rows as the operator's docstring says."""
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without passages that one with a smaller id has. Whole tables and whole texts; odd rows as the operator's docstring says."""
    from .substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests. Whole tables and whole texts; odd rows as the operator's docstring says."""
    import public_tokenizers

    from .lexicon import encode

    return encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=False).drop("ids", "decoded")


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds of k-means over all vectors, eight clusters. Whole tables; odd rows as the operator's docstring says."""
    from .kmeans import cluster

    return cluster(_table(spark, sf_dir, "embeddings"))


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of the sources by weight takes. Whole tables and whole texts; odd rows as the operator's docstring says."""
    from .mixture import mix

    # the key is a logarithm, whose last bit differs between libraries
    return mix(_table(spark, sf_dir, "documents")).drop("key")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation. Whole tables and whole texts; odd rows as the operator's docstring says."""
    from .conversations import damage, digests, repair

    conversations = _table(spark, sf_dir, "conversations")
    return digests(conversations, repair(damage(conversations)))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_main_text, op2_best_fit_packing, op3_toxicity, op4_url_filter, op5_quality_rules,
            op6_license_scan, op7_nearest, op8_near_dedup, op9_substring_dedup, op10_bpe, op11_yinyang, op12_mixture, op13_conversation_repair,
        )
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
