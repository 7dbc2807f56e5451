"""Sources of a code estate: file trees, commit logs, diffs, configuration; and the index and export sinks."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, line_count
from .durable import stored
from .versions import open_version, publish

MAX_FILES, MAX_BYTES = 200_000, 512 * 1024

#: Folders that are not scanned (nor are hidden ones), and extensions that are.
SKIPPED = "node_modules .git dist build out target coverage .next .nuxt .svelte-kit __pycache__ .venv venv .idea .vscode vendor bin obj".split()
SCANNED = (
    ".ts .tsx .js .jsx .mjs .cjs .java .kt .scala .py .rb .go .rs .cs .cpp .c .h .php .swift .dart .html .htm .css .scss .sass .less"
    " .sql .plsql .pls .pck .pks .pkb .prc .fnc .trg .pkg .json .yaml .yml .toml .xml .properties .env .osw .md .mdx .graphql .gql .proto"
).split()


def scan_files(spark: SparkSession, root: str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(rel_path, ext, size, modified, lines, content) of the source files below root, first by path.

    Hidden and skipped folders, other extensions and larger files are left out
    by path and size before any content is decoded. Files without a byte are
    none to Spark's reader.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^{re.escape(base)}/", "")
    parts = F.split(rel, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    fine = ~F.exists(folders, lambda p: p.startswith(".") | p.isin(*SKIPPED)) & extension(rel).isin(*SCANNED) & (F.col("length") <= max_bytes)
    text = F.decode("content", "UTF-8")
    kept = raw.where(fine).select(rel.alias("rel_path"), extension(rel).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), text.alias("content"))
    return kept.orderBy("rel_path").limit(max_files).select("rel_path", "ext", "size", "modified", line_count(F.col("content")).alias("lines"), "content")


def changed_files(files: DataFrame, cache: DataFrame | None) -> DataFrame:
    """(rel_path): files (rel_path, modified) that the cache doesn't hold with the same time; all without a cache."""
    if cache is None:
        return files.select("rel_path")
    old = cache.select("rel_path", F.col("modified").alias("was"))
    return files.join(old, "rel_path", "left").where(~F.col("modified").eqNullSafe(F.col("was"))).select("rel_path")


def save_cache(files: DataFrame, path: str, version: int = 1) -> None:
    files.select("rel_path", "modified", F.lit(version).alias("version")).write.mode("overwrite").parquet(path)


def load_cache(spark: SparkSession, path: str, version: int = 1) -> DataFrame | None:
    """The cache, or None if there is none of this version."""
    try:
        cache = spark.read.parquet(path)
    except Exception as e:  # Spark's analysis error for a path that is not there
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    kept = cache.where(F.col("version") == version)
    return None if kept.isEmpty() else kept.drop("version")


def commit_log(lines: DataFrame) -> DataFrame:
    """(sha, ts, author, subject, file, is_fix) of logs as text: a header line ``sha|epoch|author|subject``, then a file a line.

    lines: (log, line_no, value), of any length, ordered by line_no. All lines
    are sorted in parts; each part carries on from the last header of the parts
    before it, so a log that is most of the table is many tasks' work. Files
    before a log's first header, and empty or null lines, are nobody's.
    """
    from pyspark.sql import Window

    from ..operators.score import is_fix

    head = r"^([0-9a-f]{7,40})\|(\d+)\|([^|]*)\|(.*)$"
    own = F.when(F.col("value").rlike(head), F.struct("log", F.col("value").alias("line")))
    ordered = lines.select("log", "line_no", "value").orderBy("log", "line_no")
    parts = stored(ordered.select("log", "value", own.alias("own"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")), "log")
    # a row for each part of the sort, however long the logs are
    lasts = parts.groupBy("part").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("n"))).alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = F.broadcast(lasts.select("part", before.alias("carried")))
    within = F.last("own", ignorenulls=True).over(Window.partitionBy("part").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = parts.withColumn("at", within).join(carried, "part").withColumn("at", F.coalesce("at", "carried"))
    rows = placed.where(F.col("own").isNull() & (F.trim("value") != "") & F.col("at").isNotNull() & F.col("at.log").eqNullSafe(F.col("log")))
    part = lambda i: F.regexp_extract("at.line", head, i)
    return rows.select(part(1).alias("sha"), part(2).cast("long").cast("timestamp").alias("ts"), part(3).alias("author"), part(4).alias("subject"), F.col("value").alias("file"), is_fix(part(4)).alias("is_fix"))


def diff(*parts: DataFrame) -> DataFrame:
    """(file): what any of the change lists holds: staged, unstaged, untracked, or a range."""
    out = parts[0].select("file")
    for p in parts[1:]:
        out = out.union(p.select("file"))
    return out.where("file is not null and file != ''").distinct()


def write_index(relations: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Publishes the given relations, each with its declared columns, as the next version of the index; rows of each."""
    return {name: r["rows"] for name, r in publish(relations, path)["relations"].items() if name in relations}


def open_index(spark: SparkSession, path: str, views: bool = True, version: int | None = None) -> dict[str, DataFrame] | None:
    """The relations of a version of the index (the last), also as temporary views, or None if there is none."""
    found = open_version(spark, path, version)
    for name, df in (found or {}).items() if views else ():
        df.createOrReplaceTempView(name)
    return found


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def export_analysis(metrics: DataFrame, patterns: DataFrame, risks: DataFrame, impacts: DataFrame, tables: DataFrame) -> DataFrame:
    """One row: top 20 hotspots by debt, patterns by count, risks by level, top 10 files by transitive impact, foreign keys."""

    def listed(df: DataFrame, columns: list[str], name: str) -> DataFrame:
        return df.agg(F.collect_list(F.struct(*columns)).alias(name))

    hot = metrics.orderBy(F.desc("debt"), "rel_path").limit(20)
    near = impacts.orderBy(F.desc("transitive"), "file").limit(10)
    levels, kinds = risks.groupBy("level").agg(F.count("*").alias("n")), patterns.groupBy("pattern").agg(F.count("*").alias("n"))
    out = listed(hot, ["rel_path", "debt", "cc"], "hotspots")
    for part in (listed(kinds, ["pattern", "n"], "patterns"), listed(levels, ["level", "n"], "risks"), listed(near, ["file", "direct", "transitive"], "impact")):
        out = out.crossJoin(part)  # one row each
    return out.crossJoin(tables.agg(F.count("*").alias("tables"), F.coalesce(F.sum("n_foreign"), F.lit(0)).alias("foreign_keys")))


def summary(export: DataFrame) -> DataFrame:
    return export.select(*(F.size(c).alias(f"n_{c}") for c in ("hotspots", "patterns", "risks", "impact")), "tables", "foreign_keys")


def strip_jsonc(text: str) -> str:
    """JSON with comments and trailing commas as JSON; strings are left alone."""
    out = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m[1] or m[2], out)


def path_aliases(tsconfig: str) -> list[tuple[str, str]]:
    """(prefix, folder) of a tsconfig's paths, its baseUrl before each folder."""
    options = json.loads(strip_jsonc(tsconfig)).get("compilerOptions", {})
    base = options.get("baseUrl", ".").strip("./")
    found = []
    for alias, targets in options.get("paths", {}).items():
        for t in targets[:1]:
            folder = "/".join(p for p in (base, t.removeprefix("./").removesuffix("*").rstrip("/")) if p)
            found.append((alias.removesuffix("*").rstrip("/"), folder))
    return sorted(found, key=lambda x: -len(x[0]))


def apply_aliases(imports: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """imports (from_file, spec) with aliased specs written from the root, as ``./``-free paths under ``target``."""
    spec: Column = F.col("spec")
    target = F.lit(None).cast("string")
    for prefix, folder in reversed(aliases):
        rest = F.substring(spec, len(prefix) + 1, 10_000)
        target = F.when((spec == prefix) | spec.startswith(prefix + "/"), F.concat(F.lit(folder), rest)).otherwise(target)
    return imports.withColumn("target", target)


def project_config(spark: SparkSession, path: str) -> DataFrame:
    """The rules file: rules, outOfScope, alerts, roi."""
    schema = (
        "rules array<struct<id:string,severity:string,description:string,`from`:struct<layer:string,module:string,path:string>,`to`:struct<layer:string,module:string,path:string>>>,"
        "outOfScope array<struct<id:string,decision:string>>, alerts struct<healthDrop:int,criticalRisk:boolean,ruleViolation:boolean>, roi struct<hoursPerPoint:double,hourlyRate:double,currency:string>"
    )
    return spark.read.schema(schema).option("multiLine", "true").json(path)
