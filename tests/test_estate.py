"""Sources, detectors, parsers and graph building over a small code estate of our own."""

import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import build, detect, levels, parse, traverse
from codestrata.sources import estate

FILES = {
    "web/src/pages/order-list.ts": 'import { OrderApi } from "../api/order-api";\nexport class OrderListPage {\n  constructor(private api: OrderApi) {}\n  load() {\n    this.api.list();\n    fetch("/api/v1/orders/" + id);\n    if (a && b) { x(); } else if (c ?? d) { y(); }\n  }\n}\n',
    "web/src/api/order-api.ts": 'import axios from "axios";\nexport class OrderApi {\n  list() {\n    return axios.get("/api/v1/orders");\n  }\n}\n// TODO later\nconst password = "hunter22";\n',
    "web/src/api/index.ts": 'export { OrderApi } from "./order-api";\n',
    "web/src/app.module.ts": "@NgModule({\n  declarations: [AppComponent, OrderComponent],\n  imports: [RouterModule.forRoot([{ path: 'x', loadChildren: () => import('./lazy/lazy.module') }])],\n  providers: []\n})\nexport class AppModule {}\nexport const load = createAction('[x] load');\n",
    "web/screens/order.osw": '{"title": "OrderController", "x": ["abc"]}',
    "web/screens/orderList.osw": '{"title": "x", "Shared": 1, "list": ["Shared", "Panel", "lower", "Order List"]}',
    "web/a/OrderListView.tsx": "//", "web/a/OrderList.tsx": "//", "web/a/Shared.js": "//", "web/b/Shared.tsx": "//", "web/a/Panel.ts": "//",
    "back/src/OrderController.java": 'package com.shop.web;\nimport com.shop.core.OrderService;\n@RestController\n@RequestMapping("/orders")\npublic class OrderController {\n  private final OrderService service;\n  @PreAuthorize("hasRole(\'ROLE_ADMIN\')")\n  @GetMapping("/orders/{id}")\n  public Order get(String id) {\n    return service.find(id);\n  }\n}\n',
    "back/src/OrderService.java": "package com.shop.core;\npublic interface OrderService {\n  Order find(String id);\n}\n",
    "back/src/OrderServiceImpl.java": 'package com.shop.core;\n@Service\npublic class OrderServiceImpl implements OrderService {\n  private final OrderRepository repo;\n  @Transactional(propagation = Propagation.REQUIRES_NEW, readOnly = true)\n  public Order find(String id) {\n    return repo.load(id);\n  }\n  @Scheduled(cron = "0 0 * * *")\n  public void nightly() {\n  }\n}\n',
    "back/src/OrderRepository.java": 'package com.shop.core;\npublic interface OrderRepository extends JpaRepository<Order, Long> {\n  @Query(value = "SELECT o.id FROM ORDERS o JOIN ITEMS i ON 1=1", nativeQuery = true)\n  Order load(String id);\n  @Procedure("PKG_ORDER.CLOSE_ORDER")\n  void close();\n}\n',
    "back/src/Order.java": 'package com.shop.core;\n@Entity\n@Table(name = "ORDERS")\npublic class Order {\n  @Id\n  private Long id;\n  @Column(name = "TOTAL_AMOUNT")\n  private Double total;\n  @ManyToOne\n  private Customer customer;\n}\nenum Kind {\n  OPEN,\n  CLOSED\n}\n',
    "db/pkg_order.pkb": "CREATE OR REPLACE PACKAGE BODY shop.PKG_ORDER AS\n  PROCEDURE CLOSE_ORDER(p_id NUMBER) IS\n  BEGIN\n    UPDATE ORDERS SET state = 1 WHERE id = p_id;\n    INSERT INTO AUDIT_LOG SELECT id FROM ORDERS;\n    PKG_MAIL.SEND(p_id);\n    EXECUTE IMMEDIATE 'x';\n  END;\nEND;\n",
    "db/tables.sql": "CREATE TABLE ORDERS (\n  ID NUMBER PRIMARY KEY,\n  TOTAL NUMBER(10,2),\n  CUSTOMER_ID NUMBER REFERENCES CUSTOMERS,\n  CONSTRAINT fk FOREIGN KEY (CUSTOMER_ID) REFERENCES CUSTOMERS (ID)\n);\nCREATE OR REPLACE TRIGGER trg_orders\nBEFORE INSERT\nON ORDERS\nBEGIN NULL; END;\nCREATE SYNONYM mailer FOR PKG_MAIL;\n",
    "node_modules/x/index.ts": "skipped",
    ".hidden/a.ts": "skipped",
    "web/readme.bin": "skipped",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("estate")
    for path, text in FILES.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    return base


@pytest.fixture(scope="module")
def files(spark, root):
    return estate.scan_files(spark, f"file://{root}").cache()


def test_scan(files):
    got = {r.rel_path: r.lines for r in files.collect()}
    assert set(got) == {p for p in FILES if not p.startswith(("node_modules", ".hidden")) and not p.endswith(".bin")}
    assert got["web/src/api/index.ts"] == 2


def test_changes_and_cache(spark, files, tmp_path):
    path = f"file://{tmp_path}/cache"
    assert estate.load_cache(spark, path) is None
    estate.save_cache(files.where("rel_path like 'db/%'"), path)
    left = estate.changed_files(files, estate.load_cache(spark, path))
    assert left.where("rel_path like 'db/%'").isEmpty() and left.count() == files.count() - 2
    assert estate.load_cache(spark, path, version=2) is None


def test_log_and_diff(spark):
    rows = [("l", i, v) for i, v in enumerate(["abcdef1|1700000000|Ann|Fix the bug", "a.ts", "b.ts", "", "abcdef2|1700000100|Bo|prefix feature", "a.ts"])]
    got = estate.commit_log(spark.createDataFrame(rows, "log string, line_no int, value string")).collect()
    assert sorted((r.sha[-1], r.author, r.file, r.is_fix) for r in got) == [("1", "Ann", "a.ts", True), ("1", "Ann", "b.ts", True), ("2", "Bo", "a.ts", False)]
    assert estate.commit_log(spark.createDataFrame([], "log string, line_no int, value string")).isEmpty()
    one = spark.createDataFrame([("a",), ("b",), (None,)], "file string")
    assert sorted(r.file for r in estate.diff(one, one).collect()) == ["a", "b"]


def test_long_logs_are_read_in_parts(spark):
    """One log that is nearly all rows, with few headers, cut by the sort into parts without any; logs do not run into each other."""
    rng = random.Random(3)
    rows, want = [], []
    for log, n in (("a", 3), ("b", 4000), (None, 9), ("c", 30)):
        sha = None
        for i in range(n):
            if rng.random() < (0.002 if log == "b" else 0.2):
                sha = f"{rng.randrange(16**8):08x}"
                rows.append((log, i, f"{sha}|{i}|Ann|go on"))
            else:
                rows.append((log, i, rng.choice([f"{log}{i}", f"{log}{i}", " ", None])))
                if sha and rows[-1][2] and rows[-1][2].strip():
                    want.append((sha, rows[-1][2]))
    rng.shuffle(rows)
    got = estate.commit_log(spark.createDataFrame(rows, "log string, line_no int, value string").repartition(5))
    assert sorted((r.sha, r.file) for r in got.collect()) == sorted(want)


def test_config():
    text = '{ // note\n "compilerOptions": {"baseUrl": "./src", "paths": {"@app/*": ["app/*"], "@/*": ["./*",]}, }, /* "x" */ "s": "a//b" }'
    assert estate.path_aliases(text) == [("@app", "src/app"), ("@", "src")]


def test_risks(files):
    got = {(r.title, r.rel_path, r.line) for r in detect.risks(files).collect()}
    assert ("open task", "web/src/api/order-api.ts", 7) in got and ("hard-coded credential", "web/src/api/order-api.ts", 8) in got


def test_modules(spark):
    """A monorepo: a sub-project with its domains deep down, one without, a source tree, small folders, a shared name, and files outside."""
    paths = [f"shop-backend/src/main/java/com/acme/{d}/F{i}.java" for d in ("order", "user") for i in range(6)]
    # tests beside the sources end the search of another sub-project: their packages branch before the domains
    paths += [f"pay-backend/src/{m}/java/com/acme/{d}/F{i}.java" for m in ("main", "test") for d in ("card", "cash") for i in range(6)]
    paths += [f"shop-backend/src/main/java/com/acme/tiny/F{i}.java" for i in range(2)]
    paths += [f"shop-frontend/src/p{i}.ts" for i in range(3)] + ["shop-frontend/package.json", "shop-frontend/src/a.ts"]
    paths += [f"src/order/a{i}.ts" for i in range(7)] + [f"src/x{i}.ts" for i in range(2)] + [f"docs/d{i}.md" for i in range(3)] + ["README.md"]
    got = {r.rel_path: r.module for r in detect.modules(spark.createDataFrame([(x,) for x in paths], "rel_path string")).collect()}
    assert set(got) == set(paths)
    assert {got[p] for p in paths if "/order/" in p and p.startswith("shop")} == {"backend/order"} and {got[p] for p in paths if "/user/" in p} == {"backend/user"}
    assert {got[p] for p in paths if p.startswith("pay")} == {"backend"}
    assert {got[p] for p in paths if "/tiny/" in p} == {"backend"}  # folded into the module that has its top folder's short name
    assert {got[p] for p in paths if p.startswith("shop-frontend")} == {"frontend", "frontend/src"}  # no host of five files to fold into
    assert {got[p] for p in paths if p.startswith("src/order")} == {"order"} and {got[p] for p in paths if p.startswith("src/x")} == {"src"}
    assert got["README.md"] is None and {got[p] for p in paths if p.startswith("docs")} == {"docs"}


def test_endpoints_calls_permissions(files):
    ends = detect.endpoints(files)
    assert ("GET", "/orders/{id}") in {(r.method, r.path) for r in ends.collect()}
    calls = {(r.url, r.method, r.confidence) for r in detect.http_calls(files).collect()}
    assert ("/api/v1/orders", "GET", "high") in calls and ("/api/v1/orders/", "GET", "low") in calls
    marks = detect.permissions(files, ends).collect()
    assert [(r.kind, r.roles, r.endpoint) for r in marks] == [("pre-authorize", ["ADMIN"], "GET /orders/{id}")]


def test_plsql(files):
    objects = {(r.kind, r.name, r.pkg, r.table) for r in detect.plsql_objects(files).collect()}
    assert {("package", "PKG_ORDER", None, None), ("procedure", "CLOSE_ORDER", "PKG_ORDER", None), ("trigger", "TRG_ORDERS", None, "ORDERS"), ("synonym", "MAILER", None, "PKG_MAIL")} <= objects
    access = {(r.object, r.table, r.mode) for r in detect.plsql_table_access(files).collect()}
    assert {("PKG_ORDER.CLOSE_ORDER", "ORDERS", "write"), ("PKG_ORDER.CLOSE_ORDER", "AUDIT_LOG", "write"), ("PKG_ORDER.CLOSE_ORDER", "ORDERS", "read")} <= access
    calls = {(r.callee, r.pkg, r.dynamic) for r in detect.plsql_calls(files).collect()}
    assert calls == {("SEND", "PKG_MAIL", False), (None, None, True)}
    assert {(r.name, r.pkg) for r in detect.db_calls(files).collect()} == {("CLOSE_ORDER", "PKG_ORDER")}


def test_orm_and_sql(spark, files):
    got = {(r.file.rpartition("/")[2], r.table, r.mode) for r in detect.orm_mappings(files).collect()}
    assert {("OrderRepository.java", "ORDERS", "access"), ("OrderRepository.java", "ORDERS", "read"), ("OrderRepository.java", "ITEMS", "read"), ("Order.java", "ORDERS", "access")} <= got
    q = spark.createDataFrame([("INSERT INTO T (a, b) VALUES (:x, ?1)",), ("UPDATE s.U SET c = 1, d = 2 WHERE e = 3",), ("SELECT v.f, g FROM V v",)], "sql string")
    assert {(r.table, r.column, r.mode) for r in detect.sql_columns(q, "sql").collect()} == {("T", "A", "write"), ("T", "B", "write"), ("U", "C", "write"), ("U", "D", "write"), ("V", "F", "read"), ("V", "G", "read")}


def test_transactions_jobs_rules(files):
    t = detect.transactions(files).collect()
    assert [(r.scope, r.propagation, r.read_only) for r in t] == [("method", "REQUIRES_NEW", True)]
    assert [(r.kind, r.schedule, r.method) for r in detect.batch_jobs(files).collect()] == [("scheduled", "0 0 * * *", "nightly")]
    enums = [r["values"] for r in detect.business_rules(files).where("type = 'enum'").collect()]
    assert enums == [["OPEN", "CLOSED"]]


def test_patterns_osw_stack(files):
    got = {(r.file.rpartition("/")[2], r.pattern, r.source) for r in detect.patterns(files).collect()}
    assert ("OrderController.java", "Controller", "name") in got and ("OrderServiceImpl.java", "Service", "text") in got and ("Order.java", "Entity", "text") in got
    links = {(r.from_file.rpartition("/")[2], r.to_file.rpartition("/")[2], r.confidence) for r in detect.osw_links(files).collect()}
    assert links == {("orderList.osw", "OrderListView.tsx", "resolved"), ("orderList.osw", "OrderList.tsx", "inferred"), ("orderList.osw", "Shared.js", "inferred"), ("orderList.osw", "Shared.tsx", "inferred"), ("orderList.osw", "Panel.ts", "resolved")}
    assert ("language", "Java", 5) in {tuple(r) for r in detect.stack(files).collect()}


def test_inheritance(spark):
    rows = [("A", "class", None, [], "f"), ("B", "class", "A", [], "f"), ("C", "class", "B", ["I"], "f"), ("I", "interface", None, [], "f"), ("X", "class", "Y", [], "f"), ("Y", "class", "X", [], "f"), ("D", "class", "Outside", [], "f")]
    c = spark.createDataFrame(rows, "name string, kind string, parent string, interfaces array<string>, file string")
    got = {r.name: (r.depth, r.is_root, r.is_leaf) for r in detect.inheritance(c).collect()}
    assert got["A"] == (1, True, False) and got["C"] == (3, False, True) and got["D"] == (1, True, True) and got["X"] == (None, False, False) and got["I"] == (1, True, False)


def test_inheritance_of_long_chains(spark):
    """Depths beyond 50, by brute force: a chain, a bush with a hot parent, a cycle and what hangs on it."""
    parent = {f"k{i}": f"k{i - 1}" if i else None for i in range(131)} | {f"b{i}": f"k{i % 3 and 60}" for i in range(300)}
    parent |= {"x": "z", "y": "x", "z": "y", "below": "x", "lower": "below", "self": "self", "out": "Outside", "under": "out"}

    def depth(name):
        seen = []
        while name in parent and name not in seen:
            seen.append(name)
            name = parent[name]
        return None if name in seen else len(seen)

    c = spark.createDataFrame([(k, v, []) for k, v in parent.items()], "name string, parent string, interfaces array<string>")
    got = {r.name: (r.parent, r.depth, r.is_root, r.is_leaf) for r in detect.inheritance(c).collect()}
    assert got == {k: (v, depth(k), depth(k) == 1, k not in parent.values()) for k, v in parent.items()}


def test_parsers(files):
    tables = {r.name: r for r in parse.db_schema(files).collect()}
    sql = parse.parse_tables("t.sql", ".sql", FILES["db/tables.sql"])[0]
    assert [c["name"] for c in sql["columns"]] == ["ID", "TOTAL", "CUSTOMER_ID"] and sql["primary_key"] == ["ID"] and {f["table"] for f in sql["foreign_keys"]} == {"CUSTOMERS"}
    assert set(tables) == {"ORDERS"}
    jpa = parse.parse_tables("Order.java", ".java", FILES["back/src/Order.java"])[0]
    assert jpa["primary_key"] == ["id"] and [c["name"] for c in jpa["columns"]] == ["id", "TOTAL_AMOUNT", "customer"]
    django = parse.parse_tables("m.py", ".py", "class Book(models.Model):\n    title = models.CharField(max_length=9)\n    author = models.ForeignKey('Author', on_delete=1)\n")[0]
    assert django["foreign_keys"] == [{"column": "author", "table": "Author", "ref_column": None}] and [c["nullable"] for c in django["columns"]] == [False, False]
    prisma = parse.parse_tables("s.prisma", ".prisma", "model User {\n  id Int @id\n  posts Post[] @relation\n}\n")[0]
    assert prisma["primary_key"] == ["id"] and prisma["foreign_keys"] == [{"column": "posts", "table": "Post", "ref_column": None}]
    assert parse.parse_tables("s.js", ".js", "sequelize.define('Dog', { id: { type: DataTypes.INTEGER, primaryKey: true }, name: DataTypes.STRING })")[0]["primary_key"] == ["id"]
    ng = {(r.kind, r.name): r for r in parse.angular(files).collect()}
    assert ng["module", "AppModule"].parts["declarations"] == ["AppComponent", "OrderComponent"] and ng["module", "AppModule"].lazy == ["./lazy/lazy.module"] and ("action", "load") in ng


def test_sql_definitions():
    text = """-- a comment with CREATE TABLE no (x int);
    CREATE GLOBAL TEMPORARY TABLE IF NOT EXISTS shop."Order Line" (
      ID NUMBER(10, 0) NOT NULL, CODE VARCHAR2(20 CHAR) DEFAULT 'a,(b' UNIQUE, "Made At" TIMESTAMP,
      ORDER_ID INT REFERENCES shop.ORDERS (ID) ON DELETE CASCADE, A INT, B INT CHECK (B IN (1, 2)),
      CONSTRAINT pk PRIMARY KEY (ID, CODE), CONSTRAINT fk FOREIGN KEY (A, B) REFERENCES `PAIRS` (X, Y), UNIQUE (A), CHECK (A > 0)
    ) TABLESPACE t; CREATE TABLE copy AS SELECT 1; CREATE TABLE last (k int primary key)"""
    made = parse.parse_tables("t.pck", ".pck", text)
    assert [t["name"] for t in made] == ["Order Line", "last"]
    assert [(c["name"], c["type"], c["nullable"], c["unique"]) for c in made[0]["columns"]] == [
        ("ID", "NUMBER(10,0)", False, False), ("CODE", "VARCHAR2(20 CHAR)", True, True), ("Made At", "TIMESTAMP", True, False), ("ORDER_ID", "INT", True, False), ("A", "INT", True, True), ("B", "INT", True, False),
    ]
    assert made[0]["primary_key"] == ["ID", "CODE"] and made[1]["primary_key"] == ["k"] and not made[1]["columns"][0]["nullable"]
    assert [(f["column"], f["table"], f["ref_column"]) for f in made[0]["foreign_keys"]] == [("ORDER_ID", "ORDERS", "ID"), ("A", "PAIRS", "X"), ("B", "PAIRS", "Y")]


def test_symbols_and_resolution(files):
    facts = parse.symbols(files).cache()
    rel = parse.symbol_relations(facts)
    assert ("repo", "load") in {(r.receiver, r.method) for r in rel["calls"].collect()}
    java = rel["types"].where("file like '%.java'")
    none = rel["imports"].select("file", "name", F.lit(None).cast("string").alias("origin")).where("name = ''")
    edges = {(r.from_file.rpartition("/")[2], r.to_file.rpartition("/")[2], r.kind, r.confidence) for r in build.symbol_edges(rel["calls"], java, rel["fields"], none).collect()}
    assert ("OrderController.java", "OrderServiceImpl.java", "call", "resolved") in edges  # through the only implementor
    assert ("OrderServiceImpl.java", "OrderRepository.java", "call", "resolved") in edges  # an interface without one
    assert ("OrderServiceImpl.java", "OrderService.java", "implements", "resolved") in edges
    specs = rel["imports"].select(F.col("file").alias("from_file"), "spec").distinct()
    local, external = build.resolve_imports(specs, files)
    assert ("web/src/pages/order-list.ts", "web/src/api/order-api.ts") in {(r.from_file, r.to_file) for r in local.collect()}
    assert "axios" in {r.package for r in external.collect()}


def test_ambiguous_interface(spark):
    s = "array<struct<name:string,kind:string>>"
    types = spark.createDataFrame([("i", "I", "interface", "p", []), ("a", "A", "class", "p", [("I", "implements")]), ("b", "B", "class", "p", [("I", "implements")]), ("u", "U", "class", "p", [])], f"file string, name string, kind string, package string, supers {s}")
    calls = spark.createDataFrame([("u", "x", "go")], "file string, receiver string, method string")
    fields = spark.createDataFrame([("u", "x", "I")], "file string, name string, type string")
    imports = spark.createDataFrame([], "file string, name string, origin string")
    got = {(r.from_file, r.to_file, r.confidence) for r in build.symbol_edges(calls, types, fields, imports).where("kind = 'call'").collect()}
    assert got == {("u", "a", "inferred"), ("u", "b", "inferred")}
    followed = build.barrels(spark.createDataFrame([("u", "N", "x")], "file string, name string, origin string"), spark.createDataFrame([("x", "N", "y"), ("y", "N", "z")], "file string, name string, origin string"))
    assert [r.origin for r in followed.collect()] == ["z"]


def test_call_graph_and_trace(spark, files):
    nodes, edges = build.call_graph(
        detect.http_calls(files), detect.endpoints(files), detect.db_calls(files), detect.plsql_objects(files).select("name", "file", "line"),
        detect.plsql_calls(files).where("not dynamic").select(F.substring_index("caller", ".", -1).alias("caller"), "callee"), detect.orm_mappings(files).select("file", "table", "mode"),
    )
    kinds = {(r.type, r.confidence) for r in edges.collect()}
    assert ("HTTP_CALL", "high") in kinds or ("HTTP_CALL", "low") in kinds
    assert {"DB_CALL", "PLSQL_CALL", "TABLE_ACCESS"} <= {k for k, _ in kinds}
    empty = spark.createDataFrame([], "from_file string, to_file string, confidence string")
    links = traverse.trace_edges(empty, nodes, edges)
    entry = traverse.resolve_entry(nodes, "close_order").first().id
    up = {r.id: r for r in traverse.trace(links, nodes.select(F.coalesce("file", "id").alias("id"), "layer"), entry).collect()}
    assert "back/src/OrderRepository.java" in up and up[entry].depth == 0


def test_dead_and_layers(spark):
    f = spark.createDataFrame([("a/App.tsx",), ("a/Used.tsx",), ("a/Lost.tsx",), ("a/x.ts",)], "rel_path string")
    e = spark.createDataFrame([("a/App.tsx", "a/Used.tsx")], "from_file string, to_file string")
    assert [r.id for r in levels.dead_files(f, e, r"\.tsx$").collect()] == ["a/Lost.tsx"]


def test_index_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    assert estate.open_index(spark, path) is None
    edges = spark.createDataFrame([("a", "b", "import", "resolved")], "from_file string, to_file string, kind string, confidence string")
    assert estate.write_index({"edges": edges, "modules": spark.createDataFrame([("m",)], "name string")}, path) == {"edges": 1, "modules": 1}
    found = estate.open_index(spark, path)
    assert set(found) == {"edges", "modules"} and spark.sql("select * from edges").collect() == edges.collect() and found["modules"].first().layer is None
