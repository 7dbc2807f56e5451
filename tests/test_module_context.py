"""The report of a module: sections, order and what a budget leaves of them."""

from codestrata.operators.levels import module_context


def report(spark, n=4, size=40, n_risks=2, budget=75_000, module="core"):
    files = [(f"core/f{i}.ts", "core", i) for i in range(n)] + [("core/f0.ts", "core", None), ("web/x.js", "web", 9)]
    texts = [(f"core/f{i}.ts", str(i) * size) for i in range(n)] + [("core/f1.ts", "1" * size), ("core/none.ts", None)]
    edges = [("web/x.js", "core/f2.ts"), ("core/f0.ts", "core/f2.ts"), ("core/f0.ts", "core/f3.ts"), ("core/f0.ts", "web/x.js")]
    risks = [("high", f"r{i}", "core/f1.ts", i) for i in range(n_risks)] + [("low", "other", "web/x.js", 1), (None, None, "core/f0.ts", None)]
    served = [("GET", "/b", "core/f0.ts", 2), ("GET", "/a", "core/f0.ts", 1), ("PUT", "/c", "web/x.js", 1)]
    frames = [
        spark.createDataFrame(files, "rel_path string, module string, lines int"), spark.createDataFrame(texts, "rel_path string, content string"),
        spark.createDataFrame(edges, "from_file string, to_file string"), spark.createDataFrame(risks, "level string, title string, rel_path string, line int"),
        spark.createDataFrame(served, "method string, path string, file string, line int"),
    ]
    rows = [tuple(r) for r in module_context(module, *frames, budget=budget).collect()]
    out = {}
    for section, place, text, cut in rows:
        out.setdefault(section, []).append((place, text, cut))
    return {k: sorted(v) for k, v in out.items()}


def texts(rows):
    assert [p for p, _, _ in rows] == list(range(1, len(rows) + 1))
    return [t for _, t, _ in rows]


def test_whole_report(spark):
    got = report(spark)
    assert texts(got["module"]) == ["core, 4 files, 3 risks, 2 endpoints, .ts"]
    assert texts(got["file"]) == ["core/f0.ts (0 lines)", "core/f1.ts (1 lines)", "core/f2.ts (2 lines) *", "core/f3.ts (3 lines) *"]
    assert texts(got["risk"]) == ["core/f0.ts", "[HIGH] r0 core/f1.ts:0", "[HIGH] r1 core/f1.ts:1"]
    assert texts(got["endpoint"]) == ["GET /a core/f0.ts:1", "GET /b core/f0.ts:2"]
    assert texts(got["content"]) == [f"core/f{i}.ts\n" + str(i) * 40 for i in (2, 3, 0, 1)]


def test_many_files_are_counted_and_twenty_risks_shown(spark):
    got = report(spark, n=60, n_risks=30)
    assert len(got["file"]) == 51 and got["file"][-1] == (51, "and 10 more", True)
    assert len(got["risk"]) == 20 and len(got["content"]) == 10


def test_budget_cuts_contents_and_then_sections(spark):
    two, three = report(spark, size=16_000, budget=10_000), report(spark, size=16_000, budget=11_000)
    assert [(t[:10], cut) for _, t, cut in two["content"]] == [("core/f2.ts", False), ("core/f3.ts", False)]
    assert [(t[:10], cut) for _, t, cut in three["content"]] == [("core/f2.ts", False), ("core/f3.ts", False), ("core/f0.ts", True)]
    assert sum(-(-len(t) // 4) for rows in three.values() for _, t, _ in rows) <= 11_000
    few = report(spark, budget=1_000)
    assert set(few) == {"module", "file"}
    assert set(report(spark, budget=12)) == {"module"}


def test_unknown_module(spark):
    assert report(spark, module="no") == {"module": [(1, "no, 0 files, 0 risks, 0 endpoints", False)]}
