"""The stored index against a scan of all texts: scores, changes, what is read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codestrata.operators import postings, search
from codestrata.operators.postings import Index, add
from codestrata.sources import versions


def corpus(n, seed=1):
    rng = random.Random(seed)
    some = [f"{a}{b}" for a in ("order", "orders", "ordinal", "price", "list", "invoice") for b in ("", "ing", "able", "x")]
    return {f"f{i:04}": " ".join(rng.choice(some) if rng.random() < 0.2 else f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}z" for _ in range(rng.randrange(60))) for i in range(n)}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "rel_path string, content string").repartition(3)


def scan(spark, texts, query, top=10):
    return [tuple(r) for r in search.bm25(frame(spark, texts), "rel_path", "content", query, top).collect()]


def test_scores_are_those_of_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_DOCS", 20)
    path, texts = f"file://{tmp_path}/i", corpus(400)
    add(frame(spark, texts), path)
    index = Index(spark, path)
    for query, top in (("order", 10), ("Price InvoiceX", 3), ("ord list", 500), ("nothing here", 10), ("ordx", 5), ("a b", 5)):
        assert [tuple(r) for r in index.bm25(query, top).collect()] == (scan(spark, texts, query, top) if search.query_tokens(query) else [])
    got = {r.term: r.n for r in index.lookup("invoice").collect()}
    want = {}
    for t in texts.values():
        for w in set(re.findall("[a-z]{3,}", t)):
            want[w] = want.get(w, 0) + w.startswith("invoice")
    assert got == {w: n for w, n in want.items() if n}


def test_blocks_below_the_best_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_DOCS", 10)
    texts = {f"f{i:04}": f"common filler words number {'rare ' * (20 if i < 3 else i % 15 == 0)}" for i in range(600)}
    add(frame(spark, texts), path := f"file://{tmp_path}/i")
    index = Index(spark, path)
    assert [tuple(r) for r in index.bm25("rare", 3).collect()] == scan(spark, texts, "rare", 3)
    assert 8 <= index.read < index._all("headers").where("term = 'rare'").count()


def test_the_filter_reaches_the_scan(spark, tmp_path):
    add(frame(spark, corpus(50)), path := f"file://{tmp_path}/i")
    index = Index(spark, path)
    plan = index._matching("postings", ["order"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,order)" in plan


def test_changed_and_deleted_documents(spark, tmp_path, monkeypatch):
    """After each change the index equals one of the texts as they are now; segments before are left as they lie."""
    monkeypatch.setattr(postings, "BLOCK_DOCS", 25)
    path, texts = f"file://{tmp_path}/i", corpus(120)
    add(frame(spark, texts), path)
    rng = random.Random(4)
    for step in range(3):
        before = versions.manifest(spark, path)["relations"]
        changed = {k: v for k, v in corpus(130, 10 + step).items() if rng.random() < 0.15 or k >= "f0120"}
        gone = rng.sample(sorted(set(texts) - set(changed)), 4)
        texts = {k: v for k, v in (texts | changed).items() if k not in gone}
        assert add(frame(spark, changed), path, gone=spark.createDataFrame([(g,) for g in [*gone, next(iter(changed)), "never"]], "rel_path string")) == step + 1
        after = versions.manifest(spark, path)["relations"]
        assert all(after[k] == v for k, v in before.items()) and len(after) == len(before) + 3
        index = Index(spark, path)
        assert {r.key for r in index.documents().collect()} == set(texts)
        for query in ("order", "list price"):
            assert [tuple(r) for r in index.bm25(query).collect()] == scan(spark, texts, query)
    postings.compact(spark, path, into := f"file://{tmp_path}/j")
    whole = Index(spark, into)
    assert whole.segments == [0] and [tuple(r) for r in whole.bm25("order").collect()] == scan(spark, texts, "order")


def test_an_opened_index_does_not_change(spark, tmp_path):
    add(frame(spark, {"a": "order one"}), path := f"file://{tmp_path}/i")
    index = Index(spark, path)
    add(frame(spark, {"b": "order two", "a": "none"}), path)
    assert [r.key for r in index.bm25("order").collect()] == ["a"] and [r.key for r in Index(spark, path).bm25("order").collect()] == ["b"]


def test_inverted_and_odd_rows(spark, tmp_path):
    rows = [("a", "orderList price"), ("a", "orderList price"), ("b", None), ("c", ""), (None, "order"), ("d", "ORDER orders ordering")]
    docs = spark.createDataFrame(rows, "rel_path string, content string")
    terms = search.terms(F.col("content"))
    add(docs, path := f"file://{tmp_path}/i", tokens=terms)
    index = Index(spark, path)
    want = search.inverted(docs.where("rel_path is not null").dropDuplicates().withColumn("terms", search.terms(F.coalesce("content", F.lit("")))), "rel_path", "terms", "order list")
    assert [tuple(r) for r in index.inverted("order list").collect()] == [tuple(r) for r in want.collect()]
    assert {r.key for r in index.documents().collect()} == {"a", "b", "c", "d"}
    add(docs.limit(0), empty := f"file://{tmp_path}/e")
    assert Index(spark, empty).bm25("order").collect() == []
    with pytest.raises(ValueError, match="no index"):
        Index(spark, f"file://{tmp_path}/none")


def test_tasks_follow_the_size(spark, tmp_path, monkeypatch):
    """More documents are more tasks, not larger ones: the session has four partitions."""
    monkeypatch.setattr(postings, "BLOCK_DOCS", 20)
    monkeypatch.setattr(postings, "TASK_BYTES", 1000, raising=False)
    monkeypatch.setattr(postings, "TASK_ROWS", 400, raising=False)
    texts = corpus(200) | {"empty": "", "long": "order list " * 500}
    add(frame(spark, texts), path := f"file://{tmp_path}/i")
    index = Index(spark, path)
    rows = index.relations["postings-0"].count()
    assert len(index.relations["postings-0"].inputFiles()) > rows // 800 > 4
    headers = index._all("headers")
    assert headers.count() == headers.select("term", "block").distinct().count() and headers.agg(F.sum("n")).first()[0] == rows
    assert {r.key: r.size for r in index.documents().collect()} == {k: len(re.findall("[a-z]{3,}", t)) for k, t in texts.items()}
    assert [tuple(r) for r in index.bm25("order").collect()] == scan(spark, texts, "order")


def test_tasks_of_a_changed_segment_follow_the_size(spark, tmp_path, monkeypatch):
    """Also where documents are indexed again with other texts, and what the first segment says of them is void."""
    monkeypatch.setattr(postings, "BLOCK_DOCS", 20)
    monkeypatch.setattr(postings, "TASK_BYTES", 1000, raising=False)
    monkeypatch.setattr(postings, "TASK_ROWS", 400, raising=False)
    texts = corpus(200)
    changed = {k: v for i, (k, v) in enumerate(texts.items()) if i % 2}
    add(frame(spark, texts | {k: f"order list {v[:20]}" for k, v in changed.items()}), path := f"file://{tmp_path}/i")
    add(frame(spark, changed), path)
    index = Index(spark, path)
    for name in ("postings-0", "postings-1"):
        assert len(index.relations[name].inputFiles()) > index.relations[name].count() // 800 > 2
    assert len(index.relations["postings-1"].inputFiles()) > 4
    assert [tuple(r) for r in index.bm25("order list").collect()] == scan(spark, texts, "order list")


@pytest.mark.parametrize("tokens", [None, "array(cast(null as string))"], ids=["empty", "null terms"])
def test_documents_without_words_are_dealt_out_too(spark, tmp_path, monkeypatch, tokens):
    """They have no bytes of text, but a key and a size: a million of them are no task's share."""
    monkeypatch.setattr(postings, "TASK_BYTES", 1000)
    made, keep = [], postings.stored
    monkeypatch.setattr(postings, "stored", lambda df, name="table": made.append(keep(df, name)) or made[-1])
    docs = spark.range(400).select(F.format_string("f%04d", "id").alias("rel_path"), F.when(F.col("id") % 2 == 0, "").alias("content"))
    add(docs if tokens is None else docs.select("rel_path"), path := f"file://{tmp_path}/i", tokens=tokens and F.expr(tokens))
    shares = [r[1] for r in made[0].groupBy(F.input_file_name()).count().collect()]
    assert sum(shares) == 400 and max(shares) < 100
    assert Index(spark, path).documents().count() == 400 and Index(spark, path).bm25("order").collect() == []


def test_a_task_deals_out_few_files_of_words(spark, tmp_path, monkeypatch):
    """Tasks that deal words out by term grow in number, not in what they hold; the session is left as it was."""
    monkeypatch.setattr(postings, "TASK_BYTES", 1000)
    monkeypatch.setattr(postings, "SCAN_BYTES", 4 << 20, raising=False)
    made, scans, keep, put = [], [], postings.stored, postings.publish
    monkeypatch.setattr(postings, "stored", lambda df, name="table": made.append(keep(df, name)) or made[-1])
    monkeypatch.setattr(postings, "publish", lambda *a, **b: scans.append(made[0].select("*").rdd.getNumPartitions()) or put(*a, **b))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    add(frame(spark, texts := corpus(200)), path := f"file://{tmp_path}/i")
    assert scans == [len(made[0].inputFiles())] and scans[0] > 16
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert [tuple(r) for r in Index(spark, path).bm25("order").collect()] == scan(spark, texts, "order")
