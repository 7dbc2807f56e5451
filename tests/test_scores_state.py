"""Scores, comparisons, state, traversal, search and streams on hand-sized tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from codestrata.api import TOOLS, Estate
from codestrata.functions.text import glob_regex, js_round
from codestrata.operators import govern, levels, score, search, traverse
from codestrata.streaming import live


def test_rounding_and_globs(spark):
    got = spark.range(1).select(*(js_round(F.lit(x)).alias(f"c{i}") for i, x in enumerate((-2.5, 2.5, -0.4)))).first()
    assert tuple(got) == (-2, 3, 0)
    import re

    assert re.match(glob_regex("src/**/*.ts"), "src/a/b/c.ts") and re.match(glob_regex("src/**/*.ts"), "src/c.ts") and not re.match(glob_regex("src/*.ts"), "src/a/c.ts")


def test_walks_match_brute_force(spark):
    rng = random.Random(4)
    pairs = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(26)}
    e = spark.createDataFrame([(a, b, rng.choice(["resolved", "inferred"])) for a, b in pairs if a != b], "from_id string, to_id string, confidence string")
    rows = [(r.from_id, r.to_id, r.confidence) for r in e.collect()]
    best, level, depth = {}, {"n0": "resolved"}, 0
    while level:
        depth += 1
        nxt = {}
        for a, b, c in rows:
            if b in level and a != "n0" and a not in best:
                sure = level[b] if c == "resolved" else "inferred"
                nxt[a] = max(nxt.get(a, "inferred"), sure)
        best |= {a: (depth, c) for a, c in nxt.items()}
        level = nxt
    for edges in (e, e.orderBy(F.rand(1))):
        got = {r.id: (r.depth, r.confidence) for r in traverse.reach(edges, spark.createDataFrame([("n0",)], "seed string")).collect()}
        assert got == best
    def reaches(a, b):
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            for p, q, _ in rows:
                if p == x and q not in seen:
                    seen.add(q)
                    todo.append(q)
        return b in seen
    assert {(r.from_id, r.to_id) for r in traverse.circular(e, source="from_id", target="to_id").collect()} == {(a, b) for a, b, _ in rows if reaches(b, a)}


def test_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "from_file string, to_file string")
    assert [r.id for r in traverse.find_path(e, "a", "e").collect()] == ["a", "b", "d", "e"]
    assert traverse.find_path(e, "e", "a").collect() == [] and traverse.find_path(e, "a", "a").count() == 1


def test_levels_keep_totals(spark):
    files = spark.createDataFrame([(f"f{i}", f"m{i % 4}", f"l{i % 2}") for i in range(12)], "rel_path string, module string, layer string")
    edges = spark.createDataFrame([(f"f{i}", f"f{(i * 5 + 1) % 12}", "resolved" if i % 3 else "inferred") for i in range(12)], "from_file string, to_file string, confidence string")
    shown = levels.level(edges, files, modules=("m0",), shown=2)
    ids = {x for r in shown.collect() for x in (r.from_id, r.to_id)}
    assert any(i.startswith("file:") for i in ids) and any(i.startswith("module:") for i in ids)
    every = levels.level(edges, files, modules=("m0", "m1", "m2", "m3"), shown=10)
    assert every.agg(F.sum("weight")).first()[0] == edges.where("from_file != to_file").count()


def test_roi(spark):
    d = spark.createDataFrame([("a", 30), ("b", 10)], "module string, debt long")
    r = score.roi_total(d, spark.createDataFrame([(120,), (60,)], "impacted long")).first()
    assert (r.hours, r.cost, r.days, r.saved_hours) == (20.0, 1000.0, 2.5, 15.0)


def test_ownership(spark):
    c = spark.createDataFrame([("f1", "ann", 8), ("f1", "bo", 1), ("f2", "bo", 1), ("g1", "cy", 1), ("g1", "di", 1), ("g1", "ed", 1)], "file string, author string, commits long")
    m = spark.createDataFrame([("f1", "m", 5, 9, 0), ("f2", "m", 7, 6, 3), ("g1", "n", 1, 0, 0)], "file string, module string, cc long, in_degree long, debt long")
    got = {r.module: (r.owner, r.pct, r.authors, r.bus_factor) for r in score.ownership(c, m).collect()}
    assert got == {"m": ("ann", 80, 2, 1), "n": ("cy", 33, 3, 2)}
    assert [(r.file, r.author, r.weight) for r in score.knowledge_risk(c, m).collect()] == [("f2", "bo", 9)]


def test_health_bounds(spark):
    t = "files long, lines long, debt long, risk_weight double, violations long, dead long, coupled long, inferred long, edges long"
    worst = score.health_score(spark.createDataFrame([(10, 10, 9999, 9999.0, 99, 10, 10, 9, 9)], t)).collect()
    assert len(worst) == 6 and worst[0].score == 0 and worst[0].grade == "E"
    assert score.health_score(spark.createDataFrame([(10, 1000, 0, 0.0, 0, 0, 0, 0, 0)], t)).first().score == 100


def test_complexity(spark):
    code = "if (a && b || c) {} else if (d ?? e) {} /* if */ // while\nfor (;;) { x ? y : z } 'case' switch (q) { case 1: } try {} catch (e) {}"
    assert spark.range(1).select(score.complexity(F.lit(code))).first()[0] == 1 + 2 + 1 + 1 + 1 + 1 + 1 + 1 + 1 + 1  # if, else if, &&, ||, ??, for, ?, case, catch


def test_delta_gates_triage(spark):
    run = lambda s, risks, mods: {"health": spark.createDataFrame([(s,)], "score double"), "risks": spark.createDataFrame(risks, "file string, title string, level string"), "violations": spark.createDataFrame([], "rule_id string, from_file string, to_file string"), "modules": spark.createDataFrame([(m,) for m in mods], "name string")}
    events = {(r.type, r.severity) for r in govern.self_delta(run(85.0, [], ["a"]), run(72.0, [("f", "t", "critical")], ["b"])).collect()}
    assert events == {("health-down", "critical"), ("new-risk", "critical"), ("module-added", "info"), ("module-removed", "info")}
    assert govern.self_delta(None, run(1.0, [], [])).count() == 0
    found = spark.createDataFrame([("new-risk", "high", "k"), ("new-rule-violation", "warn", "k")], "section string, severity string, key string")
    got = {r.gate: r.failed for r in govern.gates(found, -5.0, "new-high-risks,new-rule-violations,health-drop:5,nonsense").collect()}
    assert got == {"new-high-risks": True, "new-rule-violations": False, "health-drop:5": False}
    assert govern.gates(found, None, "nonsense").collect() == []
    items = spark.createDataFrame([("a", "t", "bug", "low", "ready-for-agent")], "id string, title string, category string, priority string, state string")
    fresh = spark.createDataFrame([("a", "t", "risk", "high"), ("b", "t", "risk", "high"), ("b", "t", "risk", "high")], "id string, title string, category string, priority string")
    synced = govern.triage_sync(items, fresh)
    assert sorted((r.id, r.state) for r in synced.collect()) == [("a", "ready-for-agent"), ("b", "needs-triage")]
    assert govern.manual_item(synced, "m1", "x", "bug").where("id = 'm1'").first().state == "needs-triage"
    assert [r.id for r in govern.triage_list(synced).collect()] == ["b", "a"]


def test_portfolio_and_compliance(spark):
    rows = spark.createDataFrame([("a", "A", 90.0, 1), ("a", "A", 50.0, 2), ("b", "B", None, 1), ("c", "C", 70.0, 1)], "id string, name string, score double, ts int")
    assert [r.id for r in govern.portfolio(rows).collect()] == ["a", "c", "b"]
    assert [r.id for r in govern.portfolio(rows, spark.createDataFrame([("a",)], "id string")).collect()] == ["c", "b"]
    n = govern.rule_compliance(spark.createDataFrame([("r",), ("s",)], "rule_id string"), spark.createDataFrame([("r",), ("r",)], "rule_id string"))
    assert {r.rule_id: r.n for r in n.collect()} == {"r": 2, "s": 0}


def test_search(spark):
    v = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 2.0]), ("z", [0.0, 0.0]), ("w", [1.0, 1.0])], "k string, v array<float>")
    assert [(r.k, r.score) for r in search.vector_search(v, "k", "v", [1.0, 0.0], 4).collect()] == [("x", 1.0), ("w", 0.707), ("y", 0.0), ("z", 0.0)]
    assert search.query_tokens("findUserById in") == ["find", "user", "finduserbyid"]
    d = spark.createDataFrame([("a", "order order list"), ("b", "ordering"), ("c", "nothing")], "k string, t string")
    assert {r.k for r in search.bm25(d, "k", "t", "order").collect()} == {"a", "b"}


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=s), "health-down" if i % 2 else "new-risk", "critical", -12 if i == 1 else -1) for i, s in enumerate([0, 5, 12, 40, 44, 300])]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, type string, severity string, change int")
    assert sorted(r.n for r in live.debounced(table).collect()) == [1, 2, 3]
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    live.append_activity(live.once(stream), f"{tmp_path}/log", f"{tmp_path}/c1").awaitTermination()
    assert live.compact_activity(spark, f"{tmp_path}/log", 2).count() == 2
    sent, errors = [], []
    live.dispatch_alerts(stream, f"{tmp_path}/c2", sent.extend, errors=errors).awaitTermination()
    assert sorted(r.event_id for r in sent) == [0, 1, 2, 4] and not errors
    live.dispatch_alerts(stream, f"{tmp_path}/c3", lambda rows: 1 / 0, errors=errors).awaitTermination()
    assert len(errors) == 1


def test_incremental_equals_full(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2\n3"), ("c", "4")], "rel_path string, content string")
    extract = lambda f: f.select(F.col("rel_path").alias("file"), F.col("content").alias("x"))
    old = spark.createDataFrame([("a", "1"), ("b", "old"), ("gone", "9")], "file string, x string")
    changed = spark.createDataFrame([("b",), ("c",)], "rel_path string")
    assert sorted(live.incremental(old, files, changed, extract).collect()) == sorted(extract(files).collect())
    assert live.incremental(None, files, files.select("rel_path"), extract).count() == 3


def test_tools(spark):
    files = spark.createDataFrame([("a", "m", "backend", 1), ("b", "n", "frontend", 0)], "rel_path string, module string, layer string, in_degree long")
    edges = spark.createDataFrame([("b", "a", "import", "resolved")], "from_file string, to_file string, kind string, confidence string")
    e = Estate({"files": files, "edges": edges, "modules": spark.createDataFrame([("m", 1)], "name string, file_count long")})
    assert len(TOOLS) == 50
    assert e.call("find_path", start="b", goal="a").count() == 2 and e.call("get_impact", file="a").first().direct == 1
    assert [r.name for r in e.call("search_module", query="m").collect()] == ["m"]


def test_object_report(spark):
    objects = spark.createDataFrame([("procedure", "PAY", "BILL", "b.sql", 3), ("procedure", "PAY", "CASH", "c.sql", 9), ("function", "REPAY_ALL", None, "d.sql", 1)], "kind string, name string, pkg string, file string, line int")
    calls = [(f"x{i:02}", "db_PAY", "PLSQL_CALL", None) for i in range(12)] + [("x00", "db_PAY", "DB_CALL", None), ("web", "db_PAY", "HTTP_CALL", None), ("db_PAY", "db_LOG", "PLSQL_CALL", "LOG"), ("db_PAY", "db_Z", "PLSQL_CALL", None)]
    access = spark.createDataFrame([("CASH.PAY", "T1", "read"), ("PAY", "T2", "write"), ("BILL.PAY", "T3", "read")], "object string, table string, mode string")
    e = Estate({"cg_edges": spark.createDataFrame(calls, "from_id string, to_id string, type string, label string")}, {"objects": objects, "object_access": access})
    rows = [tuple(r) for r in e.call("get_plsql_object", name="cash.pay").collect()]
    assert rows[:4] == [("object", "procedure CASH.PAY", False), ("place", "c.sql:9", False), ("reads", "T1", False), ("writes", "T2", False)]
    assert [r for r in rows if r[0] == "caller"] == [("caller", f"x{i:02}", True) for i in range(10)]
    assert [r[1:] for r in rows if r[0] == "callee"] == [("LOG", False), ("db_Z", False)]
    assert e.call("get_plsql_object", name="repay").first().item == "function REPAY_ALL"
    assert [tuple(r) for r in e.call("get_plsql_object", name="none").collect()] == [("available", "BILL.PAY", False), ("available", "CASH.PAY", False), ("available", "REPAY_ALL", False)]


def test_zoom_out_of_an_entity(spark):
    edges = spark.createDataFrame([(f"file:f{i}", "table:T", "resolved") for i in range(5)] + [("job:J", "file:f0", "resolved")], "from_id string, to_id string, confidence string")
    files = spark.createDataFrame([(f"f{i}", None if i == 4 else f"m{i % 2}", "ui") for i in range(5)], "rel_path string, module string, layer string")
    e = Estate({"impact_edges": edges, "files": files})
    assert {tuple(r) for r in e.call("get_zoom_out", entity="table:T").collect()} == {("module", "m0", 2), ("module", "m1", 2), ("kind", "file", 5), ("kind", "job", 1)}
    assert {tuple(r) for r in e.call("get_zoom_out", entity="file:f0").collect()} == {("home module", "m0", 1), ("home layer", "ui", 1), ("kind", "job", 1)}
