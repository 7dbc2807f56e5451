"""Large aggregates are dealt to more tasks than the session's partitions."""

from codestrata.operators import build
from codestrata.sources import durable


def test_edges_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(durable, "TASK_ROWS", 50)
    pairs = [(f"a{i % 40}", f"b{i}") for i in range(600)]
    source = spark.createDataFrame([(a, b, "import", "resolved") for a, b in pairs], "from_file string, to_file string, kind string, confidence string")
    edges = build.dependency_edges(source, rows_in_all=len(pairs))
    assert edges.rdd.getNumPartitions() == 12
    assert {(r.from_file, r.to_file) for r in edges.collect()} == set(pairs)
    assert {r.file: (r.in_degree, r.out_degree) for r in build.degrees(edges).collect()}["a7"] == (0, 15)
