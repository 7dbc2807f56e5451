"""Edits, deletions and renames of a tree come once each, also over a restart."""

import os
import shutil

import pytest

from codestrata.streaming.changes import _Tree, watch_changes


def write(root, name, text, at=None):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    if at:
        os.utime(p, (at, at))


def look(spark, tmp_path, fail=False, **how):
    """One batch from the checkpoint on; (path, change) of it."""
    out = []

    def take(df, _):
        rows = df.collect()
        if fail:
            raise RuntimeError("lost")
        out.extend(rows)

    stream = watch_changes(spark, f"file://{tmp_path}/tree", f"file://{tmp_path}/state", shares=3, **how)
    q = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive
    return out


def names(rows):
    out = sorted((r.rel_path, r.change) for r in rows)
    assert len(out) == len(set(out))
    return out


def test_changes_over_restarts(spark, tmp_path):
    tree = tmp_path / "tree"
    write(tree, "a.py", "1", 1000)
    write(tree, "src/deep/down/b.ts", "two", 2000)
    write(tree, "src/c.ts", "3")
    write(tree, "node_modules/x/d.js", "no")
    first = look(spark, tmp_path, content=True)
    assert names(first) == [("a.py", "created"), ("src/c.ts", "created"), ("src/deep/down/b.ts", "created")]
    b = next(r for r in first if r.rel_path.endswith("b.ts"))
    assert (b.size, bytes(b.content), b.modified.timestamp()) == (3, b"two", 2000)
    assert names(look(spark, tmp_path)) == []
    write(tree, "a.py", "11", 1000)  # another size, the time as before
    write(tree, "src/deep/down/b.ts", "TWO", 3000)
    (tree / "src/c.ts").rename(tree / "src/new name é.ts")
    assert names(look(spark, tmp_path)) == [("a.py", "modified"), ("src/c.ts", "deleted"), ("src/deep/down/b.ts", "modified"), ("src/new name é.ts", "created")]
    write(tree, "a.py", "111")
    shutil.rmtree(tree / "src")
    assert names(look(spark, tmp_path)) == [("a.py", "modified"), ("src/deep/down/b.ts", "deleted"), ("src/new name é.ts", "deleted")]


def test_a_batch_that_fails_is_given_again_as_it_was(spark, tmp_path):
    """What came after the look of the failed batch is the next batch's."""
    tree = tmp_path / "tree"
    write(tree, "a.py", "1")
    assert names(look(spark, tmp_path)) == [("a.py", "created")]
    write(tree, "b.py", "2")
    with pytest.raises(Exception, match="lost"):
        look(spark, tmp_path, fail=True)
    write(tree, "c.py", "3")
    (tree / "b.py").unlink()
    assert names(look(spark, tmp_path)) == [("b.py", "created")]  # the run that takes up a batch ends with it
    assert names(look(spark, tmp_path)) == [("b.py", "deleted"), ("c.py", "created")]


def test_missing_root_and_shares(spark, tmp_path):
    assert look(spark, tmp_path) == []
    for i in range(200):
        write(tmp_path / "tree", f"m{i % 7}/p{i % 5}/q{i}/f.py", "")
    write(tmp_path / "tree", "m0/top.py", "")
    shares = [set(_Tree(f"{tmp_path}/tree", f"{tmp_path}/s", 8, 2).look(i)) for i in range(8)]
    assert sum(map(len, shares)) == 201 == len(set().union(*shares)) and max(map(len, shares)) < 100


def test_the_first_listing_of_a_look_stays(tmp_path):
    write(tmp_path / "tree", "a.py", "1")
    t = _Tree(f"{tmp_path}/tree", f"{tmp_path}/state", 1, 2)
    before = t.keep(0, 5)
    write(tmp_path / "tree", "b.py", "1")
    assert t.keep(0, 5) == before and set(t.keep(0, 6)) == {"a.py", "b.py"}
    t.forget(6)
    assert t.kept(0, 5) is None and set(t.kept(0, 6)) == {"a.py", "b.py"}
