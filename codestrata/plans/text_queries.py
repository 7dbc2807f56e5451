"""Queries of detectors over documents, of the stream operators, and of reports."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import detect, govern, levels, score
from ..streaming import live
from . import adapters as A
from .registry import query

#: The text rule pack: what the risk rules look for in code, for prose.
TEXT_RULES = [
    ("critical", "hard-coded credential", r"""(?i)(token|secret|password)\s*[:=]\s*["'][^"']{3,}["']""", None),
    ("low", "license line", r"(?i)(licensed under|released under)", None),
    ("medium", "mail address", r"[A-Za-z0-9._]+@[a-z0-9]+\.[a-z.]+", r"^\s*//"),
    ("high", "shouting", r"[A-Z]{4,}!!", None),
]


def _files(spark, sf_dir):
    return A.corpus(spark, sf_dir).withColumn("ext", F.lit(".ts"))


_LINES = A.with_sql("corpus") + ", lines AS (SELECT rel_path, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT rel_path, string_split(content, chr(10)) AS l FROM corpus) x)"
_TEXT_HITS = " UNION ALL ".join(f"SELECT '{level}' AS level, '{title}' AS title, rel_path, min(line)::INT AS line FROM lines WHERE regexp_matches(text, '{must.replace(chr(39), chr(39) * 2)}')" + (f" AND NOT regexp_matches(text, '{unless}')" if unless else "") + " GROUP BY rel_path" for level, title, must, unless in TEXT_RULES)


@query("e03_text_rules", f"{_LINES} {_TEXT_HITS}")
def text_rules(spark, sf_dir):
    return detect.line_rules(detect.lines(_files(spark, sf_dir)), TEXT_RULES)


@query("e01_languages", "SELECT 'language' AS kind, CASE lang WHEN 'en' THEN 'TypeScript' WHEN 'fr' THEN 'Java' ELSE 'Python' END AS name, count(*) AS n FROM documents GROUP BY ALL")
def languages(spark, sf_dir):
    ext = F.when(F.col("layer") == "en", ".ts").when(F.col("layer") == "fr", ".java").otherwise(".py")
    return detect.stack(A.corpus(spark, sf_dir).withColumn("ext", ext))


@query("e02_modules", """WITH f AS (SELECT doc_id, source AS top, lang AS sub FROM documents), t AS (SELECT top, count(*) AS n FROM f GROUP BY 1)
  SELECT CASE WHEN t.n >= 80 THEN top || '/' || sub ELSE top END AS module, count(*) AS n FROM f JOIN t USING (top) GROUP BY 1 ORDER BY n DESC, module LIMIT 25""")
def modules(spark, sf_dir):
    return detect.modules(A.corpus(spark, sf_dir)).where("module is not null").groupBy("module").agg(F.count("*").alias("n"))


@query("e20_layers", """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'database' WHEN 1 THEN 'frontend' WHEN 2 THEN CASE WHEN source IN ('src0', 'src1') THEN 'frontend' ELSE 'backend' END
    WHEN 5 THEN 'database' ELSE 'backend' END AS layer FROM documents""")
def layers(spark, sf_dir):
    ext = F.element_at(F.array(*(F.lit(e) for e in (".sql", ".css", ".ts", ".java", ".go", ".pkg", ".svelte"))), (F.col("doc_id") % 7 + 1).cast("int"))
    path = F.concat_ws("/", F.when(F.col("module") == "src0", "my-web").when(F.col("module") == "src1", "webapp").otherwise("screens"), F.col("doc_id").cast("string"))
    return A.corpus(spark, sf_dir).select("doc_id", detect.file_layer(path, ext).alias("layer"))


_RULE_TYPES = [("constraint", r"(?i)licen[sc]ed under"), ("constant", r"[0-9]{4,}")]


@query("e11_rules", f"{_LINES}, h AS (SELECT 'constraint' AS type, rel_path, line, trim(text, ' ') AS text FROM lines WHERE regexp_matches(text, '(?i)licen[sc]ed under') UNION ALL SELECT 'constant', rel_path, line, trim(text, ' ') FROM lines WHERE regexp_matches(text, '[0-9]{{4,}}')) SELECT type, rel_path AS file, substring(text, 1, 60) AS head, min(line)::INT AS line FROM h GROUP BY ALL")
def rules(spark, sf_dir):
    return detect.business_rules(_files(spark, sf_dir), _RULE_TYPES).select("type", "file", F.substring("text", 1, 60).alias("head"), "line")


@query("e12_range_join", f"{_LINES}, a AS (SELECT rel_path, line FROM lines WHERE text LIKE '%###%'), b AS (SELECT rel_path, line AS other FROM lines WHERE text LIKE '%$$$%') SELECT a.rel_path AS file, line::INT AS line, (SELECT min(other) FROM b WHERE b.rel_path = a.rel_path AND other BETWEEN line AND line + 4)::INT AS near FROM a")
def range_join(spark, sf_dir):
    rows = detect.lines(_files(spark, sf_dir))
    a = rows.where(F.col("text").contains("###")).select(F.col("rel_path").alias("file"), "line")
    b = rows.where(F.col("text").contains("$$$")).select(F.col("rel_path").alias("file"), F.col("line").alias("other"))
    return detect.nearest_after(a, b.withColumn("near", F.col("other")), "file", "line", "other", 4, "near")


@query("q34_children", "SELECT n_name AS parent, count(*) AS children FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY children DESC, parent LIMIT 20")
def children(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").join(F.broadcast(A.table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return detect.children_report(c.select(F.col("c_custkey").alias("name"), F.col("n_name").alias("parent")))


@query("e17_inheritance", """WITH RECURSIVE c AS (SELECT 'n' || n_name AS name, 'r' || r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'c' || c_custkey, 'n' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
  d(name, depth) AS (SELECT name, 1 FROM c WHERE parent NOT IN (SELECT name FROM c) UNION ALL SELECT c.name, depth + 1 FROM c JOIN d ON c.parent = d.name)
  SELECT c.name, parent, depth, depth = 1 AS is_root, c.name NOT IN (SELECT parent FROM c) AS is_leaf FROM c JOIN d ON c.name = d.name""")
def inheritance(spark, sf_dir):
    t = lambda n: A.table(spark, sf_dir, n)
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n"), "n_name").alias("name"), F.concat(F.lit("r"), "r_name").alias("parent"))
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.concat(F.lit("n"), "n_name").alias("parent"))
    return detect.inheritance(n.unionByName(c).withColumn("interfaces", F.expr("cast(array() as array<string>)")))


@query("q17_column_lineage", "SELECT DISTINCT 'S' || l_suppkey AS from_file, 'K' || l_partkey % 40 AS \"column\", CASE WHEN l_returnflag = 'R' THEN 'write' ELSE 'read' END AS mode FROM lineitem WHERE lower('T' || l_linenumber) = 't3'")
def column_lineage(spark, sf_dir):
    return _access(spark, sf_dir).where(F.lower("table") == "t3").select("from_file", "column", "mode").distinct()


def _access(spark, sf_dir):
    x = A.table(spark, sf_dir, "lineitem")
    return x.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("from_file"), F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("table"), F.concat(F.lit("K"), (F.col("l_partkey") % 40).cast("string")).alias("column"), F.when(F.col("l_returnflag") == "R", "write").otherwise("read").alias("mode"))


@query("q20_table_access", "SELECT 'S' || l_suppkey AS object, string_agg(DISTINCT 'K' || l_partkey % 40, ',' ORDER BY 'K' || l_partkey % 40) AS tables FROM lineitem WHERE lower('K' || l_partkey % 40) LIKE '%k1%' GROUP BY 1")
def table_access(spark, sf_dir):
    per = _access(spark, sf_dir).groupBy(F.col("from_file").alias("object")).agg(F.sort_array(F.collect_set("column")).alias("tables"))
    hit = F.filter("tables", lambda t: F.lower(t).contains("k1"))
    return per.where(F.exists("tables", lambda t: F.lower(t).contains("k1"))).select("object", F.array_join(hit, ",").alias("tables"))


@query("l01_debounce_sessions", """WITH x AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, epoch(min(ts))::BIGINT AS start, epoch(max(ts) + INTERVAL 6 HOUR)::BIGINT AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def debounce_sessions(spark, sf_dir):
    out = live.debounced(A.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), gap="6 hours", key="user_id")
    whole = lambda c: F.rint(F.unix_micros(c) / F.lit(1e6)).cast("long").alias(c)  # noqa: E731  # half seconds to the even one, as SQL casts
    return out.select("user_id", whole("start"), whole("end"), "n")


@query("l01_quiet_bursts", """WITH x AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id::VARCHAR AS user_id, epoch_us(min(ts)::TIMESTAMP) AS start, epoch_us(max(ts)::TIMESTAMP) + 21600000000 AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def quiet(spark, sf_dir):
    """Bursts of each user from the event table as a stream; the last ones end by their timers."""
    import uuid

    from ..sources.durable import shared_folder
    from ..streaming.debounce import quiet_bursts, settled

    events = A.table(spark, sf_dir, "events")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(_folder(sf_dir))
    place = f"{shared_folder(spark)}/bursts-{uuid.uuid4().hex}"
    out = quiet_bursts(source, 6 * 3600, key="user_id", patience=2).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint")
    settled(out.trigger(processingTime="1 second").start())
    return spark.read.schema("key string, start timestamp, end timestamp, n long").parquet(f"{place}/out").select(F.col("key").alias("user_id"), F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("l04_activity_stream", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def activity_stream(spark, sf_dir):
    """Hourly rates of the event table read as a stream; a late batch row would be dropped, so the watermark spans the table."""
    events = A.table(spark, sf_dir, "events")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(_folder(sf_dir))
    rates = live.activity_rates(source.withColumn("ts", F.col("ts").cast("timestamp")), late="3650 days")
    return _drained(rates, "complete").select(F.unix_timestamp("start").alias("start"), "event_type", "n")


def _folder(sf_dir: str) -> str:
    return f"{sf_dir}/event[s].parquet"


def _drained(stream, mode: str):
    """A stream's whole result so far. Tasks write every batch to the shared folder, so no row is kept by the driver."""
    import uuid

    from ..sources.durable import shared_folder

    spark, schema = stream.sparkSession, stream.schema
    place, written = f"{shared_folder(spark)}/drained-{uuid.uuid4().hex}", []

    def keep(batch, batch_id: int) -> None:
        at = f"{place}/rows-{batch_id}"
        batch.write.mode("overwrite").parquet(at)
        if at not in written:
            written.append(at)

    writer = stream.writeStream.foreachBatch(keep).outputMode(mode)
    q = writer.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    parts = written[-1:] if mode == "complete" else written  # a complete batch has all rows so far
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


@query("l06_incremental", A.with_sql("corpus") + " SELECT rel_path AS file, len(string_split(content, chr(10)))::BIGINT AS lines FROM corpus")
def incremental(spark, sf_dir):
    files = A.corpus(spark, sf_dir)
    extract = lambda f: f.select(F.col("rel_path").alias("file"), F.size(F.split("content", "\n", -1)).cast("long").alias("lines"))
    before = files.withColumn("content", F.when(F.col("doc_id") % 4 == 0, F.lit("old")).otherwise(F.col("content")))
    return live.incremental(extract(before), files, files.where("doc_id % 4 = 0"), extract)


@query("q35_module_index", """WITH m AS (SELECT DISTINCT source AS name, source || '/' AS path FROM documents UNION SELECT DISTINCT source || '-' || lang, source || '/' || lang FROM documents), f AS (SELECT source || '/' || lang || '/' || doc_id AS file, lang, n_chars FROM documents)
  SELECT name AS module, count(*) AS files, count(DISTINCT lang) AS languages, count(*) FILTER (n_chars > 5000) AS risks FROM m JOIN f ON starts_with(file, path) GROUP BY name""")
def module_index(spark, sf_dir):
    """Modules are path prefixes of two lengths, so a file counts for each that its path begins with."""
    f = A.corpus(spark, sf_dir).select(F.col("rel_path").alias("file"), F.col("layer").alias("language"), "doc_id")
    d = A.table(spark, sf_dir, "documents")
    tops = f.select(F.substring_index("file", "/", 1).alias("name"), F.concat(F.substring_index("file", "/", 1), F.lit("/")).alias("path")).distinct()
    subs = f.select(F.replace(F.substring_index("file", "/", 2), F.lit("/"), F.lit("-")).alias("name"), F.substring_index("file", "/", 2).alias("path")).distinct()
    risks = f.join(d.where("n_chars > 5000").select("doc_id"), "doc_id", "left_semi").select("file")
    return levels.module_index(tops.unionByName(subs), f.drop("doc_id"), risks)


@query("q37_module_context", "SELECT source AS module, doc_id, tokens, cum_tokens FROM (SELECT source, doc_id, ceil(length(coalesce(text, '')) / 4)::BIGINT AS tokens, sum(ceil(length(coalesce(text, '')) / 4)::BIGINT) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cum_tokens FROM documents) x WHERE cum_tokens <= 5000")
def module_context(spark, sf_dir):
    rows = score.within_budget(A.corpus(spark, sf_dir).select("module", "doc_id", "content"), "content", 5000, ["doc_id"], group="module")
    return rows.drop("content")


@query("q39_transactions", "SELECT count(*) AS \"all\", count(*) FILTER (o_orderkey % 5 = 0) AS requires_new, count(*) FILTER (o_orderkey % 3 = 0) AS read_only FROM orders")
def transactions(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, "REQUIRES_NEW").otherwise("REQUIRED").alias("propagation"), (F.col("o_orderkey") % 3 == 0).alias("read_only"))
    return detect.transaction_report(o)


@query("v07_prediction_feedback", """WITH f AS (SELECT 'f' || user_id AS file, count(*) FILTER (event_id % 2 = 0 AND event_type = 'error') AS was, count(*) FILTER (event_id % 2 = 1 AND event_type = 'error') AS now, count(*) AS n FROM events GROUP BY 1), p AS (SELECT * FROM f WHERE n % 100 >= 60)
  SELECT (SELECT count(*) FROM p) AS flagged, count(*) AS confirmed, CASE WHEN (SELECT count(*) FROM p) > 0 THEN count(*) / (SELECT count(*) FROM p) ELSE 0 END AS hit_rate FROM p WHERE now > was""")
def prediction_feedback(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").withColumn("file", F.concat(F.lit("f"), F.col("user_id").cast("string")))
    fixes = lambda odd: e.where((F.col("event_id") % 2 == odd) & (F.col("event_type") == "error")).groupBy("file").agg(F.count("*").alias("fixes"))
    predicted = e.groupBy("file").agg((F.count("*") % 100).alias("score"))
    none = spark.createDataFrame([], "file string")
    return govern.prediction_feedback(predicted, fixes(0), fixes(1), none, none)[1]


