"""Queries of the code detectors over an estate of code that the customers stand for.

Each customer is a file whose kind is its key modulo nine; the key is in all its
names, so every file has facts of its own, whose SQL needs the key alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build, detect, levels, parse, search
from . import adapters as A
from .registry import query

#: Path, extension and content of each kind; <n> is the key, <n+1> and so on its neighbours.
KINDS = [
    ("back/web/K<n>Controller.java", ".java", """package com.shop.web;
@RestController
public class K<n>Controller {
  private final K<n+1>Service service;
  @PreAuthorize("hasRole('ROLE_R<n>')")
  @GetMapping("/k<n>/{id}")
  public String get(String id) {
    return service.find(id);
  }
}
"""),
    ("back/core/K<n>Service.java", ".java", """package com.shop.core;
@Service
public class K<n>Service extends Base {
  private final K<n+1>Repository repo;
  @Transactional(propagation = Propagation.REQUIRES_NEW, readOnly = true)
  public String find(String id) {
    return repo.load(id);
  }
  @Scheduled(cron = "0 <n> * * *")
  public void nightly<n>() {
  }
}
"""),
    ("back/core/K<n>Repository.java", ".java", """package com.shop.core;
public interface K<n>Repository extends JpaRepository<K<n+1>, Long> {
  @Query(value = "SELECT o.id FROM T<n> o JOIN U<n> i ON 1=1", nativeQuery = true)
  String load(String id);
  @Procedure("PKG_<n>.CLOSE_<n>")
  void close();
}
"""),
    ("back/core/K<n>.java", ".java", """package com.shop.core;
@Entity
@Table(name = "T<n>")
public class K<n> {
  @Id
  private Long id;
  @Column(name = "TOTAL")
  private Double total;
}
"""),
    ("web/src/k<n>-api.ts", ".ts", """import { K } from "./K<n+1>Page";
import axios from "axios";
export class K<n>Api {
  list() {
    return axios.get("/api/v1/k<n-4>/7");
  }
}
// TODO later
const password = "hunter<n>";
"""),
    ("web/src/K<n>Page.ts", ".ts", """export enum State<n> {
  OPEN,
  CLOSED
}
export function f(a) {
  if (!a) throw new K<n>Error("x");
  const token = Math.random();
}
"""),
    ("db/pkg_<n>.pkb", ".pkb", """CREATE OR REPLACE PACKAGE BODY shop.PKG_<n> AS
  PROCEDURE CLOSE_<n>(p NUMBER) IS
  BEGIN
    UPDATE T<n> SET state = 1 WHERE id = p;
    INSERT INTO A<n> SELECT id FROM T<n>;
    PKG_<n+9>.CLOSE_<n+9>(p);
  END;
END;
"""),
    ("db/t<n>.sql", ".sql", """CREATE TABLE S<n> (
  ID NUMBER PRIMARY KEY,
  NAME VARCHAR2(40) NOT NULL,
  C_ID NUMBER REFERENCES S<n+9> (ID)
);
"""),
    ("screens/k<n>.osw", ".osw", '{"view": "K<n-3>Page", "x": ["abc"]}\n'),
]


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_path, ext, content, module, layer): a file for each customer."""
    n = F.col("c_custkey")
    kind = (n % len(KINDS) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(k[i]) for k in KINDS)), kind)

    def filled(text):
        for by in (-9, -4, -3, 0, 1, 9):
            text = F.replace(text, F.lit(f"<n{by:+d}>" if by else "<n>"), (n + by).cast("string"))
        return text

    rows = A.table(spark, sf_dir, "customer").select(filled(pick(0)).alias("rel_path"), pick(1).alias("ext"), filled(pick(2)).alias("content"))
    return rows.withColumn("module", F.substring_index("rel_path", "/", 1)).withColumn("layer", detect.file_layer(F.col("rel_path"), F.col("ext")))


_N = "n AS (SELECT c_custkey AS n, c_custkey % 9 AS k, c_custkey::VARCHAR AS s FROM customer)"
_PATH = "CASE k " + " ".join(f"WHEN {i} THEN replace('{k[0]}', '<n>', s)" for i, k in enumerate(KINDS)) + " END"
_WITH = f"WITH {_N}, f AS (SELECT *, {_PATH} AS file FROM n)"


@query("e02_code_modules", f"{_WITH} SELECT file AS rel_path, CASE k WHEN 0 THEN 'back/web' WHEN 4 THEN 'web' WHEN 5 THEN 'web' WHEN 6 THEN 'db' WHEN 7 THEN 'db' WHEN 8 THEN 'screens' ELSE 'back/core' END AS module FROM f")
def code_modules(spark, sf_dir):
    return detect.modules(code(spark, sf_dir))


@query("e03_risk_rules", f"""{_WITH} SELECT 'low' AS level, 'open task' AS title, file AS rel_path, 8 AS line FROM f WHERE k = 4 UNION ALL SELECT 'critical', 'hard-coded credential', file, 9 FROM f WHERE k = 4
  UNION ALL SELECT 'high', 'insecure random', file, 7 FROM f WHERE k = 5""")
def risk_rules(spark, sf_dir):
    return detect.risks(code(spark, sf_dir))


@query("e03_risk_corpus", """WITH v AS (SELECT * FROM (VALUES (0, 'critical', 'SQL by concatenation'), (1, 'critical', 'process with concatenated arguments'), (2, 'critical', 'eval of a variable'), (3, 'medium', 'empty catch'), (4, 'high', 'weak cryptography'),
    (5, 'high', 'CORS for all'), (6, 'critical', 'TLS check disabled'), (7, 'high', 'sensitive data logged')) t(k, level, title))
  SELECT level, title, 'p' || p_partkey || '.ts' AS rel_path, 2 AS line FROM part JOIN v ON p_partkey % 16 = k""")
def risk_corpus(spark, sf_dir):
    """Every other rule on a line that breaks it (parts 0 to 7 of 16), and on one that nearly does (8 to 15)."""
    breaks = ['q = "select * from t where a=" + a', 'Runtime.getRuntime().exec("ls " + d)', "eval(code)", "} catch (e) { }", 'digest("RC2")', 'cors({ origin: "*" })', "ssl: false", "console.log(cpf)"]
    near = ['q = "select * from t"', 'Runtime.getRuntime().exec("ls")', "// eval(code)", "} catch (e) { log(e) }", '// MD5 was here: digest("MD5")', 'cors({ origin: "x" })', "sslMode: off", "console.log(name)"]
    k = F.col("p_partkey")
    line = F.element_at(F.array(*(F.lit(x) for x in breaks + near)), (k % 16 + 1).cast("int"))
    files = A.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k.cast("string"), F.lit(".ts")).alias("rel_path"), F.lit(".ts").alias("ext"), F.concat(F.lit("start\n"), line, F.lit("\nend")).alias("content"))
    return detect.risks(files)


@query("e04_endpoints", f"{_WITH} SELECT 'GET' AS method, '/k' || s || '/{{id}}' AS path, file, 6 AS line FROM f WHERE k = 0")
def endpoints(spark, sf_dir):
    return detect.endpoints(code(spark, sf_dir)).select("method", "path", "file", "line")


@query("e05_http_calls", f"{_WITH} SELECT file, 5 AS line, '/api/v1/k' || (n - 4) || '/7' AS url, 'GET' AS method, 'high' AS confidence FROM f WHERE k = 4")
def http_calls(spark, sf_dir):
    return detect.http_calls(code(spark, sf_dir)).drop("call_id")


@query("e06_plsql_objects", f"{_WITH} SELECT 'package' AS kind, 'PKG_' || s AS name, NULL AS pkg, file, 1 AS line FROM f WHERE k = 6 UNION ALL SELECT 'procedure', 'CLOSE_' || s, 'PKG_' || s, file, 2 FROM f WHERE k = 6")
def plsql_objects(spark, sf_dir):
    return detect.plsql_objects(code(spark, sf_dir)).drop("table")


@query("e06b_table_access", f"""{_WITH}, o AS (SELECT 'PKG_' || s || '.CLOSE_' || s AS object, s, file FROM f WHERE k = 6)
  SELECT object, 'T' || s AS "table", 'write' AS mode, file FROM o UNION ALL SELECT object, 'A' || s, 'write', file FROM o UNION ALL SELECT object, 'T' || s, 'read', file FROM o""")
def plsql_table_access(spark, sf_dir):
    return detect.plsql_table_access(code(spark, sf_dir))


@query("e06c_plsql_calls", f"{_WITH} SELECT 'PKG_' || s || '.CLOSE_' || s AS caller, 'CLOSE_' || (n + 9) AS callee, 'PKG_' || (n + 9) AS pkg, false AS dynamic, file, 6 AS line FROM f WHERE k = 6")
def plsql_calls(spark, sf_dir):
    return detect.plsql_calls(code(spark, sf_dir))


@query("e07_db_calls", f"{_WITH} SELECT file, 5 AS line, 'CLOSE_' || s AS name, 'PKG_' || s AS pkg, 'high' AS confidence FROM f WHERE k = 2")
def db_calls(spark, sf_dir):
    return detect.db_calls(code(spark, sf_dir))


@query("e08_db_schema", f"""{_WITH}, t AS (SELECT 'S' || s AS name, 'sql' AS source, file, 'ID NUMBER false,NAME VARCHAR2(40) false,C_ID NUMBER true' AS columns, 'ID' AS keys, 'C_ID>S' || (n + 9) || '.ID' AS foreign_keys FROM f WHERE k = 7
    UNION ALL SELECT 'T' || s, 'jpa', file, 'id Long false,TOTAL Double true', 'id', '' FROM f WHERE k = 3) SELECT * FROM t""")
def db_schema(spark, sf_dir):
    t = parse.db_schema(code(spark, sf_dir))
    columns = F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"], c["nullable"].cast("string")))
    foreign = F.transform("foreign_keys", lambda k: F.concat(k["column"], F.lit(">"), F.concat_ws(".", k["table"], k["ref_column"])))
    return t.select("name", "source", "file", F.array_join(columns, ",").alias("columns"), F.array_join("primary_key", ",").alias("keys"), F.array_join(foreign, ",").alias("foreign_keys"))


@query("e09_orm_mappings", f"""{_WITH}, e AS (SELECT n AS en FROM f WHERE k = 3) SELECT file, 'T' || s AS "table", 'access' AS mode FROM f WHERE k = 3 UNION ALL SELECT file, 'T' || s, 'read' FROM f WHERE k = 2 UNION ALL SELECT file, 'U' || s, 'read' FROM f WHERE k = 2
  UNION ALL SELECT file, CASE WHEN en IS NULL THEN 'K' ELSE 'T' END || (n + 1), 'access' FROM f LEFT JOIN e ON en = n + 1 WHERE k = 2""")
def orm_mappings(spark, sf_dir):
    return detect.orm_mappings(code(spark, sf_dir))


@query("e09b_sql_access", """WITH o AS (SELECT o_orderkey AS n, o_orderkey::VARCHAR AS s FROM orders) SELECT n, 'T' || s AS "table", 'A' || s AS "column", 'write' AS mode FROM o WHERE n % 3 = 0 UNION ALL SELECT n, 'T' || s, 'B', 'write' FROM o WHERE n % 3 = 0
  UNION ALL SELECT n, 'U' || s, 'C', 'write' FROM o WHERE n % 3 = 1 UNION ALL SELECT n, 'V' || s, 'F' || s, 'read' FROM o WHERE n % 3 = 2""")
def sql_access(spark, sf_dir):
    n = F.col("o_orderkey")
    forms = ["INSERT INTO T<n> (a<n>, b) VALUES (:x, ?1)", "UPDATE x.U<n> SET c = 1 WHERE e = :e", "SELECT v.f<n> FROM V<n> v WHERE g = ?"]
    sql = F.replace(F.element_at(F.array(*(F.lit(x) for x in forms)), (n % 3 + 1).cast("int")), F.lit("<n>"), n.cast("string"))
    return detect.sql_columns(A.table(spark, sf_dir, "orders").select(n.alias("n"), sql.alias("sql")), "sql").drop("sql")


@query("e10_osw_links", f"{_WITH}, p AS (SELECT n AS pn, file AS to_file FROM f WHERE k = 5) SELECT file AS from_file, to_file, 'osw-ref' AS kind, 'resolved' AS confidence FROM f JOIN p ON pn = n - 3 WHERE k = 8")
def osw_links(spark, sf_dir):
    return detect.osw_links(code(spark, sf_dir))


@query("e11_code_rules", f"{_WITH} SELECT 'constraint' AS type, NULL AS \"values\", file, 0 AS line FROM f WHERE false UNION ALL SELECT 'enum', 'OPEN,CLOSED', file, 1 FROM f WHERE k = 5 UNION ALL SELECT 'guard', NULL, file, 6 FROM f WHERE k = 5")
def code_rules(spark, sf_dir):
    return detect.business_rules(code(spark, sf_dir)).select("type", F.array_join("values", ",").alias("values"), "file", "line")


@query("e12_permissions", f"{_WITH} SELECT file, 5 AS line, 'pre-authorize' AS kind, 'R' || s AS roles, 'GET /k' || s || '/{{id}}' AS endpoint FROM f WHERE k = 0")
def permissions(spark, sf_dir):
    f = code(spark, sf_dir)
    return detect.permissions(f, detect.endpoints(f)).select("file", "line", "kind", F.array_join("roles", ",").alias("roles"), "endpoint")


@query("e13_transactions", f"{_WITH} SELECT file, 5 AS line, 'method' AS scope, 'REQUIRES_NEW' AS propagation, true AS read_only FROM f WHERE k = 1")
def transactions(spark, sf_dir):
    return detect.transactions(code(spark, sf_dir)).drop("rollback_for")


@query("e14_batch_jobs", f"{_WITH} SELECT file, 9 AS line, 'scheduled' AS kind, '0 ' || s || ' * * *' AS schedule, 'nightly' || s AS method FROM f WHERE k = 1")
def batch_jobs(spark, sf_dir):
    return detect.batch_jobs(code(spark, sf_dir))


@query("e15_angular", """SELECT 'app/m' || s_suppkey || '.module.ts' AS file, 'module' AS kind, 'M' || s_suppkey || 'Module' AS name, 'C' || s_suppkey || ',D' AS declarations, './l' || s_suppkey || '.module' AS lazy FROM supplier
  UNION ALL SELECT 'app/m' || s_suppkey || '.module.ts', 'action', 'load' || s_suppkey, NULL, '' FROM supplier""")
def angular(spark, sf_dir):
    s = F.col("s_suppkey").cast("string")
    text = "@NgModule({\n  declarations: [C<n>, D],\n  imports: [RouterModule.forRoot([{ path: 'x', loadChildren: () => import('./l<n>.module') }])]\n})\nexport class M<n>Module {}\nexport const load<n> = createAction('[x] load');\n"
    files = A.table(spark, sf_dir, "supplier").select(F.concat(F.lit("app/m"), s, F.lit(".module.ts")).alias("rel_path"), F.lit(".ts").alias("ext"), F.replace(F.lit(text), F.lit("<n>"), s).alias("content"))
    return parse.angular(files).select("file", "kind", "name", F.array_join(F.col("parts")["declarations"], ",").alias("declarations"), F.array_join("lazy", ",").alias("lazy"))


@query("e16_patterns", f"""{_WITH} SELECT file, CASE k WHEN 0 THEN 'Controller' WHEN 1 THEN 'Service' WHEN 2 THEN 'Repository' ELSE 'Entity' END AS pattern, CASE k WHEN 3 THEN 'text' ELSE 'name' END AS source,
  CASE k WHEN 3 THEN 'K' || s END AS class_name, 'resolved' AS confidence FROM f WHERE k < 4""")
def patterns(spark, sf_dir):
    return detect.patterns(code(spark, sf_dir))


@query("e17_classes", f"""{_WITH} SELECT 'K' || s || CASE k WHEN 0 THEN 'Controller' WHEN 1 THEN 'Service' WHEN 2 THEN 'Repository' WHEN 3 THEN '' ELSE 'Api' END AS name, CASE k WHEN 2 THEN 'interface' ELSE 'class' END AS kind, CASE k WHEN 1 THEN 'Base' WHEN 2 THEN 'JpaRepository' END AS parent, file FROM f WHERE k < 5""")
def classes(spark, sf_dir):
    return detect.classes(code(spark, sf_dir)).select("name", "kind", "parent", "file")


@query("e18_symbols", f"""{_WITH} SELECT file, 'K' || s || CASE k WHEN 0 THEN 'Controller' WHEN 1 THEN 'Service' WHEN 2 THEN 'Repository' WHEN 3 THEN '' WHEN 4 THEN 'Api' END AS name, CASE k WHEN 2 THEN 'interface' ELSE 'class' END AS kind,
    CASE k WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 3 END AS line, CASE k WHEN 0 THEN 'get' WHEN 1 THEN 'find,nightly' || s WHEN 2 THEN 'load,close' WHEN 3 THEN '' ELSE 'list' END AS methods FROM f WHERE k < 5
  UNION ALL SELECT file, 'State' || s, 'enum', 1, '' FROM f WHERE k = 5""")
def symbols(spark, sf_dir):
    t = parse.symbol_relations(parse.symbols(code(spark, sf_dir)))["types"]
    return t.select("file", "name", "kind", "line", F.array_join("methods", ",").alias("methods"))


@query("g01b_imports", f"""{_WITH}, p AS (SELECT n AS pn, file AS to_file FROM f WHERE k = 5) SELECT file AS "from", to_file AS "to", 1 AS files FROM f JOIN p ON pn = n + 1 WHERE k = 4 UNION ALL SELECT 'package', 'axios', count(*) FROM f WHERE k = 4""")
def imports(spark, sf_dir):
    f = code(spark, sf_dir)
    found = parse.symbol_relations(parse.symbols(f))["imports"].where("file like '%.ts'").select(F.col("file").alias("from_file"), "spec")
    edges, external = build.resolve_imports(found, f)
    return edges.select(F.col("from_file").alias("from"), F.col("to_file").alias("to"), F.lit(1).cast("long").alias("files")).unionByName(external.select(F.lit("package").alias("from"), F.col("package").alias("to"), "files"))


@query("g02_symbol_edges", f"""{_WITH}, t AS (SELECT n AS tn, k AS tk, file AS to_file FROM f) SELECT file AS from_file, to_file, 'call' AS kind, 'resolved' AS confidence FROM f JOIN t ON tn = n + 1 AND tk = k + 1 WHERE k IN (0, 1)""")
def symbol_edges(spark, sf_dir):
    rel = parse.symbol_relations(parse.symbols(code(spark, sf_dir)))
    origin = rel["imports"].select("file", "name", F.col("spec").alias("origin"))
    return build.symbol_edges(rel["calls"], rel["types"], rel["fields"], origin)


@query("g02_barrels", "SELECT 'use' || s_suppkey AS file, 'X' AS name, 'b' || (SELECT max(s_suppkey) + 1 FROM supplier) AS origin FROM supplier")
def barrels(spark, sf_dir):
    """A chain of as many re-exports as there are suppliers."""
    s = A.table(spark, sf_dir, "supplier")
    b = lambda by: F.concat(F.lit("b"), (F.col("s_suppkey") + by).cast("string"))
    exports = s.select(b(0).alias("file"), F.lit("X").alias("name"), b(1).alias("origin"))
    return build.barrels(s.select(F.concat(F.lit("use"), F.col("s_suppkey").cast("string")).alias("file"), F.lit("X").alias("name"), b(0).alias("origin")), exports)


def _graph(spark, sf_dir):
    f = code(spark, sf_dir)
    objects = detect.plsql_objects(f).select("name", "file", "line")
    db = detect.db_calls(f)
    inner = detect.plsql_calls(f).where("not dynamic").select(F.substring_index("caller", ".", -1).alias("caller"), "callee")
    access = detect.orm_mappings(f)
    return build.call_graph(detect.http_calls(f), detect.endpoints(f), db, objects, inner, access)


@query("g04_call_graph", f"""{_WITH} SELECT 'HTTP_CALL' AS type, 'high' AS confidence, count(*) AS n FROM f a JOIN f b ON b.n = a.n - 4 WHERE a.k = 4 GROUP BY ALL
  UNION ALL SELECT 'DB_CALL', 'high', count(*) FROM f WHERE k = 2 UNION ALL SELECT 'PLSQL_CALL', 'high', count(*) FROM f WHERE k = 6
  UNION ALL SELECT 'TABLE_ACCESS', 'high', count(*) FILTER (k = 3) + 3 * count(*) FILTER (k = 2) FROM f""")
def call_graph(spark, sf_dir):
    return _graph(spark, sf_dir)[1].groupBy("type", "confidence").agg(F.count("*").alias("n"))


@query("q16_call_graph_dump", f"{_WITH} SELECT 'node' AS part, 'frontend' AS what, count(*) AS n FROM f WHERE k = 4 UNION ALL SELECT 'edge', 'PLSQL_CALL', count(*) FROM f WHERE k = 6")
def call_graph_dump(spark, sf_dir):
    dump = levels.call_graph_dump(*_graph(spark, sf_dir))
    return dump.groupBy("part", F.col("kind").alias("what")).agg(F.count("*").alias("n")).where("what in ('frontend', 'PLSQL_CALL')")


@query("g07_node_ids", f"{_WITH} SELECT file, 'fe_' || regexp_replace(file, '[^A-Za-z0-9]+', '_', 'g') AS id FROM f")
def node_ids(spark, sf_dir):
    from ..functions.text import node_id

    return code(spark, sf_dir).select(F.col("rel_path").alias("file"), node_id("fe", F.col("rel_path")).alias("id"))


@query("q13_snippets", f"""{_WITH} SELECT file, CASE k WHEN 0 THEN '@RestController | public class K' || s || 'Controller {{ | private final K' || (n + 1) || 'Service service;'
    WHEN 4 THEN 'export class K' || s || 'Api {{ | list() {{ | return axios.get("/api/v1/k' || (n - 4) || '/7");' ELSE '@Entity | @Table(name = "T' || s || '") | public class K' || s || ' {{' END AS snippet FROM f WHERE k IN (0, 3, 4)""")
def snippets(spark, sf_dir):
    shown = code(spark, sf_dir).where("rel_path like '%Controller.java' or rel_path like '%-api.ts' or (ext = '.java' and content like '%@Entity%')")
    return shown.select(F.col("rel_path").alias("file"), search.snippet(F.col("content")).alias("snippet"))


@query("q08_resolve_entry", """WITH p AS (SELECT 'p' || p_partkey AS id, upper(p_name) AS l FROM part), r AS (SELECT id, l, CASE WHEN l = 'RED' THEN 1 WHEN starts_with(l, 'RED') THEN 3 WHEN contains(l, 'RED') THEN 4 END AS rank FROM p) SELECT id, rank FROM r WHERE rank IS NOT NULL""")
def resolve_entry(spark, sf_dir):
    from ..operators import traverse

    nodes = A.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"), F.lit("none").alias("file"))
    return traverse.resolve_entry(nodes, "red")


@query("s02_changed_files", """SELECT 'C/' || c_custkey AS rel_path FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS d, max(o_totalprice) > 300000 AS big FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE d IS NULL OR big""")
def changed_files(spark, sf_dir):
    """The cache holds customers with orders, with another time where one order was large."""
    from ..sources import estate

    last = A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("d"), (F.max("o_totalprice") > 300000).alias("big"))
    name = F.concat(F.lit("C/"), F.col("c_custkey").cast("string"))
    files = A.table(spark, sf_dir, "customer").join(last, F.col("k") == F.col("c_custkey"), "left").select(name.alias("rel_path"), F.coalesce("d", F.lit("2000-01-01").cast("timestamp")).cast("timestamp").alias("modified"), "big")
    cache = files.where("big is not null").withColumn("modified", F.when(F.col("big"), F.col("modified") - F.expr("interval 1 day")).otherwise(F.col("modified")))
    return estate.changed_files(files.drop("big"), cache.drop("big"))


@query("s06_diff", "SELECT DISTINCT 'f' || json_extract_string(props, '$.k') AS file FROM events WHERE event_type IN ('error', 'view') AND json_extract_string(props, '$.k') IS NOT NULL")
def diff(spark, sf_dir):
    from ..sources import estate

    c = A.table(spark, sf_dir, "events").withColumn("file", F.concat(F.lit("f"), F.get_json_object("props", "$.k")))
    return estate.diff(c.where("event_type = 'error'"), c.where("event_type = 'view'"))


@query("s12_aliases", "SELECT 'C/' || c_custkey AS from_file, CASE c_custkey % 3 WHEN 0 THEN 'src/app/x' || c_custkey WHEN 1 THEN 'src/y' END AS target FROM customer")
def aliases(spark, sf_dir):
    from ..sources import estate

    n = F.col("c_custkey")
    spec = F.when(n % 3 == 0, F.concat(F.lit("@app/x"), n.cast("string"))).when(n % 3 == 1, "@/y").otherwise("react")
    rows = A.table(spark, sf_dir, "customer").select(F.concat(F.lit("C/"), n.cast("string")).alias("from_file"), spec.alias("spec"))
    return estate.apply_aliases(rows, [("@app", "src/app"), ("@", "src")]).drop("spec")
