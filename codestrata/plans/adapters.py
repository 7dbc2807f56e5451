"""The driver's tables seen as a code estate (DataFrames), and the same views in SQL.

A  supply graph: customers and suppliers are files, nations modules, regions layers
B  documents are files with content        C  events are a commit log
E  pages are calls to routes               F  event sequences are state changes
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.durable import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("module"), F.col("r_name").alias("layer"))
    nodes = t("customer").select(_key("C/", "c_custkey").alias("rel_path"), F.col("c_nationkey").alias("n_nationkey")).unionByName(t("supplier").select(_key("S/", "s_suppkey").alias("rel_path"), F.col("s_nationkey").alias("n_nationkey")))
    return nodes.join(F.broadcast(place), "n_nationkey").select("rel_path", "module", "layer")  # 25 nations


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = spread(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), lines.count(), "o_custkey", "l_suppkey")  # counted from the files' footers
    confidence = F.max(F.when(F.col("l_returnflag") == "R", "inferred").otherwise("resolved"))
    best = pairs.groupBy("o_custkey", "l_suppkey").agg(confidence.alias("confidence"))
    return best.select(_key("C/", "o_custkey").alias("from_file"), _key("S/", "l_suppkey").alias("to_file"), "confidence").withColumn("kind", F.lit("import"))


def impact_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    t = lambda n: table(spark, sf_dir, n)

    def rows(df, a, a_kind, b, b_kind, via, confidence="resolved"):
        c = F.lit(confidence) if confidence in ("resolved", "inferred") else F.expr(confidence)
        return df.select(_key(f"{a_kind}:", a).alias("from_id"), _key(f"{b_kind}:", b).alias("to_id"), F.lit(a_kind).alias("from_kind"), F.lit(b_kind).alias("to_kind"), F.lit(via).alias("via"), c.alias("confidence"))

    region = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = F.broadcast(t("nation"))
    sure = "case when l_returnflag = 'R' then 'inferred' else 'resolved' end"
    return [
        rows(region, "n_name", "nation", "r_name", "region", "belongs-to"),
        rows(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "c_custkey", "customer", "n_name", "nation", "belongs-to"),
        rows(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "s_suppkey", "supplier", "n_name", "nation", "belongs-to"),
        rows(t("orders"), "o_orderkey", "order", "o_custkey", "customer", "call"),
        rows(t("lineitem"), "l_orderkey", "order", "l_suppkey", "supplier", "reads", sure),
        rows(t("lineitem"), "l_orderkey", "order", "l_partkey", "part", "writes", sure),
    ]


def impact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.build import typed_edges

    return typed_edges(*impact_sources(spark, sf_dir))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, ts, author, file, is_fix)."""
    e = table(spark, sf_dir, "events")
    return e.select(_key("e", "event_id").alias("sha"), F.col("ts").cast("timestamp").alias("ts"), _key("u", "user_id").alias("author"), F.concat(F.lit("f"), F.get_json_object("props", "$.k")).alias("file"), (F.col("event_type") == "error").alias("is_fix"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_path, module, layer, content): documents as files."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("rel_path"), F.col("source").alias("module"), F.col("lang").alias("layer"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")


SQL = {
    "files": """files AS (SELECT rel_path, n_name AS module, r_name AS layer FROM (
        SELECT 'C/' || c_custkey AS rel_path, c_nationkey AS nk FROM customer UNION ALL SELECT 'S/' || s_suppkey, s_nationkey FROM supplier) x
        JOIN nation ON nk = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "edges": """edges AS (SELECT 'C/' || o_custkey AS from_file, 'S/' || l_suppkey AS to_file,
        max(CASE WHEN l_returnflag = 'R' THEN 'inferred' ELSE 'resolved' END) AS confidence, 'import' AS kind
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)""",
    "impact": """impact AS (SELECT from_id, to_id, from_kind, to_kind, via, max(c) AS confidence FROM (
        SELECT 'nation:' || n_name AS from_id, 'region:' || r_name AS to_id, 'nation' AS from_kind, 'region' AS to_kind, 'belongs-to' AS via, 'resolved' AS c FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || n_name, 'customer', 'nation', 'belongs-to', 'resolved' FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || n_name, 'supplier', 'nation', 'belongs-to', 'resolved' FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'order', 'customer', 'call', 'resolved' FROM orders
        UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'order', 'supplier', 'reads', CASE WHEN l_returnflag = 'R' THEN 'inferred' ELSE 'resolved' END FROM lineitem
        UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'order', 'part', 'writes', CASE WHEN l_returnflag = 'R' THEN 'inferred' ELSE 'resolved' END FROM lineitem
        ) x GROUP BY ALL)""",
    "commits": """commits AS (SELECT 'e' || event_id AS sha, ts, 'u' || user_id AS author, 'f' || json_extract_string(props, '$.k') AS file, event_type = 'error' AS is_fix FROM events)""",
    "corpus": """corpus AS (SELECT source || '/' || lang || '/' || doc_id AS rel_path, source AS module, lang AS layer, coalesce(text, '') AS content, doc_id FROM documents)""",
}


def with_sql(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(SQL[n] for n in names)
