"""Queries of scores, ownership, comparisons, state and search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import govern, levels, postings, score, search
from ..sources.durable import shared_folder
from ..sources.versions import open_version, publish
from . import adapters as A
from .registry import query

_NOW = "(SELECT max(ts) FROM events)"


def _now(spark, sf_dir):
    return A.table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]


def _metrics(spark, sf_dir):
    """Per file of the commit log: event kinds stand in for complexity, authors for coupling."""
    c = A.commits(spark, sf_dir).where("file is not null")
    m = c.groupBy("file").agg((F.count("*") % 37).alias("cc"), (F.count_distinct("author") % 41).alias("coupling"), (F.count("*") % 5).alias("in_degree"), (F.count("*") % 11).alias("debt"))
    return m.withColumn("module", F.concat(F.lit("m"), F.substring("file", 2, 1)))


_METRICS = """metrics AS (SELECT file, count(*) % 37 AS cc, count(DISTINCT author) % 41 AS coupling, count(*) % 5 AS in_degree, count(*) % 11 AS debt, 'm' || substring(file, 2, 1) AS module FROM commits WHERE file IS NOT NULL GROUP BY file)"""
_SQL = A.with_sql("commits") + ", " + _METRICS


@query("s04_churn", A.with_sql("commits") + f" SELECT file, count(DISTINCT sha) AS commits, count(DISTINCT CASE WHEN is_fix THEN sha END) AS fixes FROM commits WHERE ts >= {_NOW} - INTERVAL 10 DAY AND file IS NOT NULL GROUP BY file")
def churn(spark, sf_dir):
    return score.churn(A.commits(spark, sf_dir), _now(spark, sf_dir), days=10)


_AUTHORS = f""", authors AS (SELECT file, author, count(DISTINCT sha) AS commits, min(CAST(floor((epoch({_NOW}) - epoch(ts)) / 86400) AS BIGINT)) AS last_days FROM commits WHERE ts >= {_NOW} - INTERVAL 365 DAY AND file IS NOT NULL GROUP BY 1, 2)"""


@query("s05_authorship", A.with_sql("commits") + _AUTHORS + """ SELECT file, author, commits, last_days, commits / sum(commits) OVER (PARTITION BY file) AS share,
  row_number() OVER (PARTITION BY file ORDER BY commits DESC, author) = 1 AS "primary" FROM authors""")
def authorship(spark, sf_dir):
    return score.authorship(A.commits(spark, sf_dir), _now(spark, sf_dir))


@query("m06_risk_prediction", _SQL + f""", churn AS (SELECT file, count(DISTINCT sha) AS commits, count(DISTINCT CASE WHEN is_fix THEN sha END) AS fixes FROM commits WHERE ts >= {_NOW} - INTERVAL 10 DAY AND file IS NOT NULL GROUP BY file),
  m AS (SELECT file, cc, coupling, coalesce(commits, 0) AS commits, coalesce(fixes, 0) AS fixes FROM metrics LEFT JOIN churn USING (file)),
  x AS (SELECT greatest(max(cc), 1) AS a, greatest(max(coupling), 1) AS b, greatest(max(commits), 1) AS c, greatest(max(fixes), 1) AS d FROM m),
  s AS (SELECT file, CAST(floor(100 * (0.4::DOUBLE * (commits / c) + 0.2::DOUBLE * (fixes / d) + 0.2::DOUBLE * (cc / a) + 0.2::DOUBLE * (coupling / b)) + 0.5::DOUBLE) AS BIGINT) AS score,
    concat_ws(',', CASE WHEN commits / c >= 0.5 THEN 'changes often' END, CASE WHEN fixes / d >= 0.5 THEN 'fixed often' END, CASE WHEN cc / a >= 0.5 THEN 'complex' END, CASE WHEN coupling / b >= 0.5 THEN 'coupled' END) AS reasons FROM m, x)
  SELECT * FROM s WHERE score > 0 ORDER BY score DESC, file LIMIT 50""")
def risk_prediction(spark, sf_dir):
    return score.predict_risk(score.churn(A.commits(spark, sf_dir), _now(spark, sf_dir), days=10), _metrics(spark, sf_dir))


_BY = _SQL + _AUTHORS + """, by_author AS (SELECT module, author, sum(commits)::BIGINT AS commits FROM authors JOIN metrics USING (file) GROUP BY 1, 2),
  run AS (SELECT *, row_number() OVER w AS n, sum(commits) OVER w AS s, sum(commits) OVER (PARTITION BY module) AS total FROM by_author WINDOW w AS (PARTITION BY module ORDER BY commits DESC, author ROWS UNBOUNDED PRECEDING)),
  bf AS (SELECT module, min(n) AS bus_factor FROM run WHERE 2 * s >= total GROUP BY module)"""


@query("m07_bus_factor", _BY + " SELECT module, bus_factor::INT AS bus_factor FROM bf")
def bus_factor(spark, sf_dir):
    authors = score.authorship(A.commits(spark, sf_dir), _now(spark, sf_dir)).join(_metrics(spark, sf_dir).select("file", "module"), "file")
    return score.bus_factor(authors.groupBy("module", "author").agg(F.sum("commits").alias("commits")), "module")


@query("m08_ownership", _BY + """, t AS (SELECT module, arg_min(author, (-commits, author)) AS owner, max(commits) AS most, sum(commits) AS total, count(*) AS authors FROM by_author GROUP BY module),
  z AS (SELECT module, count(*) AS files, avg(cc) AS avg_cc FROM metrics GROUP BY module),
  h AS (SELECT *, CAST(floor((files * 0.3::DOUBLE + avg_cc * 1.5::DOUBLE) * (CASE WHEN bus_factor <= 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) + 0.5::DOUBLE) AS BIGINT) AS hours FROM t JOIN bf USING (module) JOIN z USING (module))
  SELECT module, owner, CAST(floor(100 * most / total + 0.5) AS BIGINT) AS pct, authors, bus_factor::INT AS bus_factor, hours, CASE WHEN hours > 40 THEN 'high' WHEN hours > 16 THEN 'medium' ELSE 'low' END AS difficulty FROM h""")
def ownership(spark, sf_dir):
    return score.ownership(score.authorship(A.commits(spark, sf_dir), _now(spark, sf_dir)), _metrics(spark, sf_dir))


@query("m10_start_here", _BY + """, z AS (SELECT module, count(*) AS files, avg(cc % 9) AS avg_cc FROM metrics GROUP BY module),
  h AS (SELECT module, CAST(floor((files * 0.3::DOUBLE + avg_cc * 1.5::DOUBLE) * (CASE WHEN bus_factor <= 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) + 0.5::DOUBLE) AS BIGINT) AS hours FROM bf JOIN z USING (module))
  SELECT module, hours FROM h WHERE hours <= 16 ORDER BY hours, module LIMIT 5""")
def start_here(spark, sf_dir):
    authors = score.authorship(A.commits(spark, sf_dir), _now(spark, sf_dir))
    return score.start_here(score.ownership(authors, _metrics(spark, sf_dir).withColumn("cc", F.col("cc") % 9))).select("module", "hours")


@query("m09_knowledge_risk", _SQL + """, severe AS (SELECT 'f' || json_extract_string(props, '$.k') AS file, 'u' || user_id AS author FROM events WHERE event_type = 'error' AND value > 300),
  one AS (SELECT file, min(author) AS author FROM severe WHERE file IS NOT NULL GROUP BY file HAVING count(DISTINCT author) = 1)
  SELECT file, author, in_degree + debt AS weight FROM one JOIN metrics USING (file) WHERE in_degree + debt >= 2 ORDER BY weight DESC, file LIMIT 30""")
def knowledge_risk(spark, sf_dir):
    """Who alone has mended severe faults (value over 300) of a file."""
    e = A.table(spark, sf_dir, "events").where("event_type = 'error' and value > 300")
    c = e.select(F.concat(F.lit("f"), F.get_json_object("props", "$.k")).alias("file"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author")).where("file is not null")
    return score.knowledge_risk(c, _metrics(spark, sf_dir), least=2)


@query("m11_reviewers", A.with_sql("commits") + _AUTHORS + """, p AS (SELECT file, arg_min(author, (-commits, author)) AS author FROM authors GROUP BY file)
  SELECT author, count(*) AS n, string_agg(file, ',' ORDER BY file) AS files FROM p SEMI JOIN (SELECT file FROM commits WHERE is_fix) c USING (file) GROUP BY author""")
def reviewers(spark, sf_dir):
    owners = score.authorship(A.commits(spark, sf_dir), _now(spark, sf_dir)).where("primary").select("file", "author")
    return score.reviewers(owners, A.commits(spark, sf_dir).where("is_fix and file is not null").select("file"))


@query("m12_roi", "SELECT n_name AS module, sum(c_custkey % 13)::BIGINT AS debt, floor(sum(c_custkey % 13) * 0.5 * 10 + 0.5) / 10 AS hours, floor(sum(c_custkey % 13) * 0.5 / 8 * 10 + 0.5) / 10 AS days, floor(sum(c_custkey % 13) * 0.5 * 50 * 100 + 0.5) / 100 AS cost FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY cost DESC, module LIMIT 20")
def roi(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").join(F.broadcast(A.table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return score.roi(c.groupBy(F.col("n_name").alias("module")).agg(F.sum(F.col("c_custkey") % 13).alias("debt")))


_STRIP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '/\\*.*?\\*/', ' ', 'gs'), '//[^\\n]*', ' ', 'g'), '\"(?:[^\"\\\\\\n]|\\\\.)*\"', ' ', 'g'), '''(?:[^''\\\\\\n]|\\\\.)*''', ' ', 'g'), '`(?:[^`\\\\]|\\\\.)*`', ' ', 'gs')"
_N = lambda p: f"len(regexp_extract_all(code, '{p}'))"
_CC = "least(1 + " + " + ".join(_N(p) for p in (r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bdo\b", r"\bcase\b", r"\bcatch\b", "&&", r"\|\|", r"\?+")) + ", 999)::BIGINT"
_FILES = A.with_sql("corpus") + f", code AS (SELECT *, {_STRIP} AS code FROM corpus), m AS (SELECT rel_path, module, len(string_split(content, chr(10)))::BIGINT AS lines, {_CC} AS cc FROM code)"


@query("m01_complexity", _FILES + " SELECT rel_path, cc FROM m")
def complexity(spark, sf_dir):
    return A.corpus(spark, sf_dir).select("rel_path", score.complexity(F.col("content")).alias("cc"))


def _file_metrics(spark, sf_dir):
    c = A.corpus(spark, sf_dir)
    degrees = c.select(F.col("rel_path").alias("file"), (F.col("doc_id") % 6).alias("in_degree"), (F.col("doc_id") % 21).alias("out_degree"))
    return score.file_metrics(c.select("rel_path", "module", "content"), degrees)


_DEBT = "(CASE WHEN cc > 20 THEN least(2 * (cc - 20), 40) ELSE 0 END + CASE WHEN lines > 1500 THEN 10 WHEN lines > 500 THEN 3 ELSE 0 END + CASE WHEN out_degree > 15 THEN least(out_degree - 15, 15) ELSE 0 END)::BIGINT"
_FM = _FILES.replace("m AS (SELECT rel_path, module,", "m AS (SELECT rel_path, module, doc_id % 6 AS in_degree, doc_id % 21 AS out_degree,") + f", fm AS (SELECT *, {_DEBT} AS debt, cc > 15 AND in_degree > 3 AS hotspot FROM m)"


@query("m02_file_metrics", _FM + " SELECT rel_path, module, lines, cc, in_degree, out_degree, debt, hotspot FROM fm")
def file_metrics(spark, sf_dir):
    return _file_metrics(spark, sf_dir)


@query("m03_module_metrics", _FM + """ SELECT module, count(*) AS files, CAST(floor(avg(cc) + 0.5) AS BIGINT) AS avg_cc, max(cc) AS max_cc, arg_min(rel_path, (-cc, rel_path)) AS max_cc_file, sum(lines)::BIGINT AS lines,
  floor(avg(in_degree) * 10 + 0.5) / 10 AS avg_in, sum(debt)::BIGINT AS debt, coalesce(array_to_string(list_sort(list(rel_path) FILTER (hotspot))[1:5], ','), '') AS hotspots FROM fm GROUP BY module""")
def module_metrics(spark, sf_dir):
    return score.module_metrics(_file_metrics(spark, sf_dir))


@query("m04_hotspots", _FM + " SELECT rel_path, debt FROM fm ORDER BY debt DESC, rel_path LIMIT 20")
def hotspots(spark, sf_dir):
    m = _file_metrics(spark, sf_dir)
    return m.orderBy(F.desc("debt"), "rel_path").limit(20).select("rel_path", "debt")


_TOTALS = """SELECT count(*) AS files, 2000::BIGINT AS lines, sum(s_suppkey % 3)::BIGINT AS debt, count(*) FILTER (s_suppkey % 10 = 0) * 0.5 AS risk_weight, count(*) FILTER (s_suppkey % 50 = 0) AS violations,
  count(*) FILTER (s_suppkey % 20 = 0) AS dead, count(*) FILTER (s_suppkey % 25 = 0) AS coupled, count(*) FILTER (s_suppkey % 4 = 0) AS inferred, count(*) AS edges FROM supplier"""


@query("m05_health", f"WITH t AS ({_TOTALS}), p AS (" + """SELECT floor(least(debt / greatest(lines / 1000.0, 1) / 2, 25) * 10 + 0.5) / 10 AS debt, floor(least(risk_weight / greatest(lines / 1000.0, 1) * 2, 25) * 10 + 0.5) / 10 AS risks,
  floor(least(violations * 100.0 / files * 2, 15) * 10 + 0.5) / 10 AS violations, floor(least(dead * 100.0 / files, 10) * 10 + 0.5) / 10 AS dead, floor(least(coupled * 100.0 / files, 15) * 10 + 0.5) / 10 AS coupling,
  floor(least(inferred * 100.0 / edges / 10, 10) * 10 + 0.5) / 10 AS inference FROM t),
  s AS (SELECT *, floor(greatest(0, 100 - (debt + risks + violations + dead + coupling + inference)) * 10 + 0.5) / 10 AS score FROM p),
  u AS (SELECT score, unnest(['debt', 'risks', 'violations', 'dead', 'coupling', 'inference']) AS dimension, unnest([debt, risks, violations, dead, coupling, inference])::DOUBLE AS penalty, unnest([25, 25, 15, 10, 15, 10])::INT AS max FROM s)
  SELECT score::DOUBLE AS score, dimension, penalty, max, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'E' END AS grade FROM u""")
def health(spark, sf_dir):
    n = lambda m: F.count(F.when(F.col("s_suppkey") % m == 0, 1))
    t = A.table(spark, sf_dir, "supplier").agg(F.count("*").alias("files"), F.lit(2000).alias("lines"), F.sum(F.col("s_suppkey") % 3).alias("debt"), (n(10) * 0.5).alias("risk_weight"), n(50).alias("violations"), n(20).alias("dead"), n(25).alias("coupled"), n(4).alias("inferred"), F.count("*").alias("edges"))
    return score.health_score(t)


@query("m16_health_delta", "SELECT project, event_id, score, score - lag(score) OVER (PARTITION BY project ORDER BY ts, event_id) AS delta FROM (SELECT 'u' || user_id AS project, ts, event_id, (event_id * 7) % 101 AS score FROM events WHERE event_type = 'error') x")
def health_delta(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("project"), F.struct("ts", "event_id").alias("at"), "event_id", ((F.col("event_id") * 7) % 101).alias("score"))
    return score.health_delta(e, ts="at").drop("at")


@query("m13_token_budget", "SELECT doc_id, tokens, cum_tokens FROM (SELECT doc_id, ceil(length(coalesce(text, '')) / 4)::BIGINT AS tokens, sum(ceil(length(coalesce(text, '')) / 4)::BIGINT) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cum_tokens FROM documents) x WHERE cum_tokens <= 75000")
def token_budget(spark, sf_dir):
    return score.within_budget(A.corpus(spark, sf_dir).select("doc_id", "content"), "content", 75_000, ["doc_id"]).drop("content")


@query("m14_usage", "SELECT event_type AS tool, count(*) AS calls, sum(event_id % 97)::BIGINT AS tokens FROM events GROUP BY 1")
def usage(spark, sf_dir):
    return score.usage(A.table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), (F.col("event_id") % 97).alias("tokens")))


@query("m15_risk_level", "SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 OR c_custkey % 101 < 40 THEN 'CRITICAL' WHEN c_custkey % 13 = 0 OR c_custkey % 101 < 60 THEN 'HIGH' WHEN c_custkey % 101 < 80 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM customer")
def risk_level(spark, sf_dir):
    k = F.col("c_custkey")
    return A.table(spark, sf_dir, "customer").select(k.alias("id"), score.risk_level(k % 101, (k % 17 == 0).cast("int"), (k % 13 == 0).cast("int")).alias("level"))


_PATHS = "paths AS (SELECT DISTINCT 'app/' || ['pages', 'hooks', 'controllers', 'lib'][(l_suppkey % 4 + 1)::INT] || '/a' || l_suppkey AS from_file, 'app/' || ['services', 'repository', 'ui'][(l_partkey % 3 + 1)::INT] || '/b' || l_partkey % 50 AS to_file FROM lineitem)"


def _paths(spark, sf_dir):
    pick = lambda names, c: F.element_at(F.array(*(F.lit(n) for n in names)), (F.col(c) % len(names) + 1).cast("int"))
    a = F.concat(F.lit("app/"), pick(("pages", "hooks", "controllers", "lib"), "l_suppkey"), F.lit("/a"), F.col("l_suppkey").cast("string"))
    b = F.concat(F.lit("app/"), pick(("services", "repository", "ui"), "l_partkey"), F.lit("/b"), (F.col("l_partkey") % 50).cast("string"))
    return A.table(spark, sf_dir, "lineitem").select(a.alias("from_file"), b.alias("to_file")).distinct()


@query("v01_layer_violations", f"WITH {_PATHS} " + """SELECT 'frontend-server' AS rule, 'high' AS severity, from_file, to_file FROM paths WHERE regexp_matches(from_file, '/(pages|hooks)/') AND regexp_matches(to_file, '/(services|repository)/')
  UNION ALL SELECT 'controller-db', 'medium', from_file, to_file FROM paths WHERE from_file LIKE '%/controllers/%' AND to_file LIKE '%/repository/%'""")
def layer_violations(spark, sf_dir):
    return govern.layer_violations(_paths(spark, sf_dir))


_RULES = [{"id": "no-asia-to-europe", "from": {"layer": "ASIA"}, "to": {"layer": "EUROPE"}, "severity": "warn", "description": "far"}, {"id": "no-french-supplier", "from": {"path": "C/1*"}, "to": {"path": "S/**", "module": "NATION_7"}}, {"id": "never", "from": {"module": "NOWHERE"}}]


@query("v03_arch_rules", A.with_sql("files", "edges") + """, x AS (SELECT from_file, to_file, a.layer AS al, b.layer AS bl, b.module AS bm FROM edges JOIN files a ON from_file = a.rel_path JOIN files b ON to_file = b.rel_path)
  SELECT 'no-asia-to-europe' AS rule_id, 'warn' AS severity, from_file, to_file, 'far' AS description FROM x WHERE al = 'ASIA' AND bl = 'EUROPE'
  UNION ALL SELECT 'no-french-supplier', 'error', from_file, to_file, '' FROM x WHERE from_file LIKE 'C/1%' AND to_file LIKE 'S/%' AND bm = 'NATION_7'""")
def arch_rules(spark, sf_dir):
    return govern.arch_rules(levels.with_ends(A.edges(spark, sf_dir), A.files(spark, sf_dir)), _RULES)


@query("v19_rule_compliance", A.with_sql("files", "edges") + """, x AS (SELECT from_file, to_file, a.layer AS al, b.layer AS bl, b.module AS bm FROM edges JOIN files a ON from_file = a.rel_path JOIN files b ON to_file = b.rel_path)
  SELECT 'no-asia-to-europe' AS rule_id, count(*) AS n FROM x WHERE al = 'ASIA' AND bl = 'EUROPE' UNION ALL SELECT 'no-french-supplier', count(*) FROM x WHERE from_file LIKE 'C/1%' AND bm = 'NATION_7' UNION ALL SELECT 'never', 0""")
def rule_compliance(spark, sf_dir):
    return govern.rule_compliance(spark.createDataFrame([(r["id"],) for r in _RULES], "rule_id string"), arch_rules(spark, sf_dir))


def _run(spark, sf_dir, odd: int):
    d = A.table(spark, sf_dir, "documents").where(F.col("doc_id") % 2 == odd)
    risks = d.where("n_chars > 3000").select(F.concat_ws("/", "source", "lang").alias("file"), F.lit("long").alias("title"), F.when(F.col("n_chars") > 9000, "critical").otherwise("medium").alias("level")).distinct()
    violations = d.select(F.col("source").alias("rule_id"), F.col("lang").alias("from_file"), (F.col("n_chars") % 5).cast("string").alias("to_file")).distinct()
    return {"health": d.agg((F.count("*") % 61).cast("double").alias("score")), "risks": risks, "violations": violations, "modules": d.where("n_chars < 150").select(F.col("source").alias("name")).distinct()}


def _run_sql(odd: int, p: str) -> str:
    return f"""{p}d AS (SELECT * FROM documents WHERE doc_id % 2 = {odd}), {p}r AS (SELECT DISTINCT source || '/' || lang AS file, 'long' AS title, CASE WHEN n_chars > 9000 THEN 'critical' ELSE 'medium' END AS level FROM {p}d WHERE n_chars > 3000),
  {p}v AS (SELECT DISTINCT source AS rule_id, lang AS from_file, (n_chars % 5)::VARCHAR AS to_file FROM {p}d), {p}m AS (SELECT DISTINCT source AS name FROM {p}d WHERE n_chars < 150), {p}h AS (SELECT (count(*) % 61)::DOUBLE AS score FROM {p}d)"""


_NEW_V = "SELECT * FROM bv EXCEPT SELECT * FROM av"


_DELTA = f"WITH {_run_sql(0, 'a')}, {_run_sql(1, 'b')} " + f"""SELECT CASE WHEN b.score < a.score THEN 'health-down' ELSE 'health-up' END AS type, CASE WHEN b.score - a.score <= -10 THEN 'critical' WHEN b.score < a.score THEN 'warn' ELSE 'info' END AS severity, 'health ' || (b.score - a.score)::BIGINT AS title FROM ah a, bh b WHERE a.score <> b.score
  UNION ALL SELECT 'new-risk', CASE WHEN level = 'critical' THEN 'critical' ELSE 'warn' END, title || ': ' || file FROM (SELECT * FROM br EXCEPT SELECT * FROM ar) x
  UNION ALL SELECT 'rule-violation', 'warn', rule_id || ' ' || from_file || ' ' || to_file FROM ({_NEW_V}) y
  UNION ALL SELECT 'module-added', 'info', name FROM (SELECT * FROM bm EXCEPT SELECT * FROM am) z UNION ALL SELECT 'module-removed', 'info', name FROM (SELECT * FROM am EXCEPT SELECT * FROM bm) w"""


@query("v06_self_delta", _DELTA)
def self_delta(spark, sf_dir):
    return govern.self_delta(_run(spark, sf_dir, 0), _run(spark, sf_dir, 1))


@query("s08_versions", _DELTA)
def versions(spark, sf_dir):
    """The same delta between two published versions of an index: what is not given anew is taken over."""
    place = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    for k in (0, 1):
        publish(_run(spark, sf_dir, k), place)
    return govern.self_delta(open_version(spark, place, 1), open_version(spark, place))


def _compared(spark, sf_dir):
    side = lambda r: {"risks": r["risks"], "rules": r["violations"].withColumn("severity", F.lit("error")), "violations": r["violations"].select(F.col("rule_id").alias("rule"), "from_file", "to_file", F.lit("high").alias("severity"))}
    predicted = risk_prediction(spark, sf_dir)
    return govern.compare(side(_run(spark, sf_dir, 0)), side(_run(spark, sf_dir, 1)), predicted, A.commits(spark, sf_dir).where("is_fix and file is not null").select("file"))


_COMPARE = f"""WITH {_run_sql(0, 'a')}, {_run_sql(1, 'b')}, c AS (SELECT 'new-risk' AS section, level AS severity, file || '|' || title AS key FROM (SELECT * FROM br EXCEPT SELECT * FROM ar) x
  UNION ALL SELECT 'new-violation', 'high', rule_id || '|' || from_file || '|' || to_file FROM ({_NEW_V}) y UNION ALL SELECT 'new-rule-violation', 'error', rule_id || '|' || from_file || '|' || to_file FROM ({_NEW_V}) y)"""


@query("v08_compare", _COMPARE + " SELECT * FROM c")
def compare(spark, sf_dir):
    return _compared(spark, sf_dir).where("section != 'risk-flag'")


@query("v09_gates", _COMPARE + """ SELECT 'new-high-risks' AS gate, count(*) > 0 AS failed, count(*) AS n FROM c WHERE section = 'new-risk' AND severity IN ('high', 'critical')
  UNION ALL SELECT 'new-rule-violations', count(*) > 0, count(*) FROM c WHERE section = 'new-rule-violation' UNION ALL SELECT 'health-drop:5', true, 0""")
def gates(spark, sf_dir):
    return govern.gates(_compared(spark, sf_dir), -6.0, "new-high-risks,new-rule-violations,health-drop:5,unknown")


def _items(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    return c, name


_STATES = list(govern.TRANSITIONS)


@query("v10_triage_sync", f"""WITH i AS (SELECT 'c' || c_custkey AS id, ['critical', 'high', 'medium', 'low'][c_custkey % 4 + 1] AS priority, {_STATES}[c_custkey % 6 + 1] AS state FROM customer WHERE c_acctbal > 5000), n AS (SELECT DISTINCT 'c' || o_custkey AS id FROM orders)
  SELECT id, id AS title, 'bug' AS category, priority, state FROM i UNION ALL SELECT id, id, 'enhancement', 'high', 'needs-triage' FROM n WHERE id NOT IN (SELECT id FROM i)""")
def triage_sync(spark, sf_dir):
    """The queue holds customers in credit, in all states; every customer with an order is a candidate."""
    c, name = _items(spark, sf_dir)
    k = F.col("c_custkey")
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))
    old = c.where("c_acctbal > 5000").select(name.alias("id"), name.alias("title"), F.lit("bug").alias("category"), pick(govern.PRIORITIES).alias("priority"), pick(_STATES).alias("state"))
    o = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    new = A.table(spark, sf_dir, "orders").select(o.alias("id"), o.alias("title"), F.lit("enhancement").alias("category"), F.lit("high").alias("priority"))
    return govern.triage_sync(old, new)


#: The allowed moves, written out once more as the reference answer.
_MOVES = """(VALUES ('needs-triage', 'needs-info'), ('needs-triage', 'ready-for-agent'), ('needs-triage', 'ready-for-human'), ('needs-triage', 'wontfix'), ('needs-info', 'needs-triage'),
  ('ready-for-agent', 'needs-triage'), ('ready-for-agent', 'done'), ('ready-for-human', 'needs-triage'), ('ready-for-human', 'done'), ('wontfix', 'needs-triage')) m(a, b)"""


@query("v11_transition", f"""WITH s AS (SELECT ['needs-triage', 'needs-info', 'ready-for-agent', 'ready-for-human', 'wontfix', 'done'] AS s), i AS (SELECT 'c' || c_custkey AS id, s[(c_custkey % 6 + 1)::INT] AS state, CASE WHEN c_acctbal > 0 THEN s[(c_custkey // 6 % 6 + 1)::INT] END AS to_state FROM customer, s),
  j AS (SELECT i.*, a IS NOT NULL AS moved FROM i LEFT JOIN {_MOVES} ON state = a AND to_state = b)
  SELECT id, CASE WHEN moved THEN to_state ELSE state END AS state, CASE WHEN to_state IS NOT NULL THEN moved OR state = to_state END AS ok, moved::INT AS steps FROM j""")
def transition(spark, sf_dir):
    """All 36 pairs of states occur."""
    c, name = _items(spark, sf_dir)
    states = F.array(*(F.lit(s) for s in _STATES))
    k = F.col("c_custkey")
    items = c.select(name.alias("id"), F.element_at(states, (k % 6 + 1).cast("int")).alias("state"), F.expr("cast(array() as array<struct<state:string,ts:timestamp>>)").alias("history"))
    changes = c.where("c_acctbal > 0").select(name.alias("id"), F.element_at(states, (F.floor(k / 6) % 6 + 1).cast("int")).alias("to_state"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    return govern.triage_transition(items, changes).select("id", "state", "ok", F.size("history").alias("steps"))


@query("v12_list", "SELECT 'c' || c_custkey AS id, ['critical', 'high', 'medium', 'low'][(c_custkey % 4 + 1)::INT] AS priority FROM customer WHERE c_custkey % 6 = 2")
def triage_list(spark, sf_dir):
    """States go round over the keys; the listed state is the third of them."""
    c, name = _items(spark, sf_dir)
    k = F.col("c_custkey")
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (k % n + 1).cast("int"))
    return govern.triage_list(c.select(name.alias("id"), pick(_STATES, 6).alias("state"), F.lit("bug").alias("category"), pick(govern.PRIORITIES, 4).alias("priority")), state="ready-for-agent", category="bug").select("id", "priority")


@query("v13_portfolio", "SELECT substring(sha1('u' || user_id), 1, 12) AS id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def portfolio(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(govern.project_id(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("id"), F.struct("ts", "event_id").alias("ts"), "event_id", F.lit(50.0).alias("score"))
    return govern.portfolio(e).select("id", "event_id")


@query("v14_alerts", "SELECT event_id FROM (SELECT event_id, event_type, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS change FROM events) x WHERE change <= -20 AND event_type = 'error'")
def alerts(spark, sf_dir):
    from pyspark.sql import Window

    change = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = A.table(spark, sf_dir, "events").withColumn("change", change).withColumn("type", F.when(F.col("event_type") == "error", "health-down").otherwise("analysis")).withColumn("severity", F.lit("warn"))
    return govern.alerts(e, drop=20).select("event_id")


@query("v15_capped_log", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) x WHERE r <= 5")
def capped_log(spark, sf_dir):
    return govern.capped(A.table(spark, sf_dir, "events"), 5, ["ts", "event_id"], key="user_id").select("event_id", "user_id")


@query("v16_history", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def history(spark, sf_dir):
    return govern.capped(A.table(spark, sf_dir, "events"), 200, ["ts", "event_id"]).select("event_id")


_BM25 = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}') AS w FROM documents), t AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w),
  f AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM w) x WHERE starts_with(term, 'license') OR starts_with(term, 'apache') GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
  SELECT doc_id, floor(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / a))) * 10 + 0.5) / 10 AS score FROM f JOIN d USING (term), t GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10"""


@query("q12_bm25", _BM25)
def bm25(spark, sf_dir):
    return search.bm25(A.corpus(spark, sf_dir), "doc_id", "content", "License Apache")


@query("q12_index", _BM25)
def bm25_of_index(spark, sf_dir):
    """The same from a stored index of all documents, of which those of one language were indexed with other texts first and have changed since."""
    place, docs = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}", A.corpus(spark, sf_dir).select("doc_id", "content", "layer")
    before = docs.withColumn("content", F.when(F.col("layer") == "de", F.concat(F.lit("apache license "), F.substring("content", 1, 200))).otherwise(F.col("content")))
    postings.add(before, place, "doc_id")
    postings.add(docs.where("layer = 'de'"), place, "doc_id")
    return postings.Index(spark, place).bm25("License Apache").withColumnRenamed("key", "doc_id")


@query("e19_terms", f"""WITH w AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(regexp_replace(regexp_replace(coalesce(text, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z]+') IF len(x) >= 3] AS w FROM documents)
  SELECT doc_id, least(400, (SELECT count(DISTINCT x) FROM unnest(w) t(x) WHERE x NOT IN {tuple(search.STOPWORDS + search.SQL_WORDS)!r}))::INT AS n_terms FROM w""")
def index_terms(spark, sf_dir):
    return A.corpus(spark, sf_dir).select("doc_id", F.size(search.terms(F.col("content"))).alias("n_terms"))


_INVERTED = """WITH w AS (SELECT doc_id, list_distinct([x FOR x IN string_split_regex(lower(regexp_replace(regexp_replace(coalesce(text, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z]+') IF len(x) >= 3]) AS w FROM documents)
  SELECT doc_id, (SELECT sum(CASE WHEN x = 'version' THEN 2 ELSE 1 END) FROM unnest(w) t(x) WHERE starts_with(x, 'version'))::BIGINT AS score FROM w WHERE len([x FOR x IN w IF starts_with(x, 'version')]) > 0 ORDER BY score DESC, doc_id LIMIT 10"""


@query("q14_inverted", _INVERTED)
def inverted(spark, sf_dir):
    docs = A.corpus(spark, sf_dir).select("doc_id", search.terms(F.col("content"), most=1_000_000).alias("terms"))
    return search.inverted(docs, "doc_id", "terms", "version")


@query("q14_index", _INVERTED)
def inverted_of_index(spark, sf_dir):
    """The same from stored postings of all terms."""
    place = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    postings.add(A.corpus(spark, sf_dir), place, "doc_id", tokens=search.terms(F.col("content"), most=1_000_000))
    return postings.Index(spark, place).inverted("version").withColumnRenamed("key", "doc_id")


@query("q15_vector_topk", """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3)
  SELECT vec_id, floor(coalesce(list_cosine_similarity(embedding::DOUBLE[], q), 0) * 1000 + 0.5) / 1000 AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""")
def vector_topk(spark, sf_dir):
    v = A.table(spark, sf_dir, "embeddings")
    return search.vector_search(v, "vec_id", "embedding", v.where("vec_id = 3").select("embedding").first()[0])


