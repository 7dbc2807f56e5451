"""Near-dedup, substring dedup and quality rules against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from codestrata.llm.near_dedup import near_duplicates
from codestrata.llm.quality import POLICIES, ablations, compare, judge, ledger, mask
from codestrata.llm.substring_dedup import deep_nodes, remove_repeats

WORD = "[^\x20\x09-\x0d]+"


def corpus(words, odd):
    rng = random.Random(3)
    base = words(300).split()
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, "\n".join(base))]
    for i in range(4, 30):  # near copies at all distances
        copy = list(base)
        for _ in range(rng.randrange(1, 12)):
            copy[rng.randrange(300)] = f"e{i}_{rng.random()}"
        rows.append((i, " ".join(copy)))
    passage = words(60, 5000)
    rows += [(40 + i, words(20 + i, 7000 + 100 * i) + " " + passage + " " + words(9, 9000 + 100 * i)) for i in range(8)]
    rows += [(60, words(50, 20000)), (61, words(49, 20000)), (62, words(50, 20000) + " tail"), (63, "A B c d"), (64, "a b C D"), (65, "a b"), (66, "b a")]
    rows += [(70, "x y " * 400), (71, "x y " * 400 + "z"), (72, words(20_000, 100_000))]
    return rows + odd


def test_near_duplicates(spark, make, words, odd):
    rows = corpus(words, odd)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(make(rows)).collect()}
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) or (frozenset([tuple(w)]) if w else frozenset())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(i for i in sets if i is not None)
    for a in known:
        for b in known:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert len(got) == len(rows)
    for i in known:
        assert got[i] == (len(sets[i]), find(i), find(i) == i), i
    assert got[None] == (1, None, True)


def test_maps_of_labels_compose(spark):
    """Two maps, one after the other, are one: chains of labels end where the second map sends them."""
    from codestrata.llm.near_dedup import _composed, _relabelled

    first = spark.createDataFrame([(5, 3), (6, 3), (9, 8)], "node long, component long")
    then = spark.createDataFrame([(3, 1), (7, 2)], "node long, component long")
    rows = spark.createDataFrame([(i,) for i in range(1, 10)], "label long")
    step = _relabelled(_relabelled(rows, first), then)
    assert sorted(_relabelled(rows, _composed(_composed(None, first), then)).collect()) == sorted(step.collect())


def test_bit_filter_loses_no_key(spark, monkeypatch):
    from codestrata.llm import near_dedup

    base = spark.createDataFrame([(i, i * 7, f"t{i}") for i in range(3000)], "doc_id long, text_key long, text string")
    keys = base.where("doc_id % 10 = 0").select("doc_id", "text_key")
    few = {r.doc_id for r in near_dedup._asked_for(base, keys).collect()}
    assert {i for i in range(0, 3000, 10)} <= few and len(few) < 400
    monkeypatch.setattr(near_dedup, "FILTER_WORDS", 1)  # full: all pass
    assert near_dedup._asked_for(base, keys).count() == 3000
    assert near_dedup._asked_for(base, keys.limit(0)).count() == 0


def test_near_duplicates_of_repeated_ids(make, words):
    """Rows with one id tie the groups of all their texts."""
    a, b, c = words(40), words(40, 1000), words(40, 2000)
    got = near_duplicates(make([(1, a), (2, a), (2, b), (3, b), (3, c), (4, c), (4, c), (9, words(30, 5000))])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 1), (3, 1), (4, 1), (4, 1), (9, 9)]


def test_near_duplicates_with_large_open_buckets(make, words):
    """Many near copies of one text, and texts that share half of it and stay open: links across labels only, none lost."""
    rng = random.Random(8)
    base, rows = words(120).split(), []
    for i in range(60):
        copy = list(base)
        for k in range(3 if i % 2 else 60):
            copy[(7 * i + k) % 120 if i % 2 else 60 + k] = f"e{i if i % 2 else i % 12}_{k}"
        rows.append((i, " ".join(copy)))
    rng.shuffle(rows)
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_duplicates(make(rows)).collect()}
    assert got == {i: find(i) for i in sets} and len(set(got.values())) > 3


def test_near_duplicates_empty(make):
    assert near_duplicates(make([])).collect() == []


def brute_repeats(rows):
    first, split = {}, {i: (t or "").encode().split() for i, t in rows}
    for i, w in sorted((i, w) for i, w in split.items() if i is not None):
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for p in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(left).hexdigest())
    return out


def test_repeats(make, words, odd):
    rows = corpus(words, odd)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(make(rows)).collect()}
    assert got == brute_repeats(rows)
    carried = remove_repeats(make(rows), carry=True).select("row.doc_id", "n_removed", "row.n_words").collect()
    assert {r.doc_id: r.n_removed for r in carried} == {i: v[1] for i, v in got.items()}
    assert all(r.n_words == 7 for r in carried)


def test_repeats_in_trees_and_below_lengthened_prefixes(make):
    """Passages of many lengths between changing neighbours: all groups sorted as trees, some lengthened, all lengthened."""
    rng = random.Random(11)
    passages = [[f"p{k}_{j % 7 if k == 3 else j}" for j in range(rng.randrange(30, 140))] for k in range(6)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randrange(1, 6)):
            x = rng.choice(passages)
            a = rng.randrange(0, 12)
            text += [f"own{i}_{rng.randrange(4)}"] * rng.randrange(0, 4) + x[a : len(x) - rng.randrange(0, 12)]
        rows.append((i, " ".join(text)))
    want = brute_repeats(rows)
    assert sum(n for _, n, _ in want.values()) > 1000
    for group_rows in (1024, 5, 0):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(make(rows), group_rows=group_rows).collect()}
        assert got == want, group_rows


def test_deep_nodes():
    """Nodes of depth 8 (window) against comparing all windows of a group with each other."""
    rng = np.random.default_rng(4)
    window, prefix = 8, 4
    n = 60
    group, doc = np.sort(rng.integers(0, 3, n)), rng.integers(0, 20, n)
    anchor = rng.integers(0, window - prefix + 1, n)
    windows = np.array([rng.integers(1, a + 2) for a in anchor])  # all hold the anchor
    texts = []
    for g, a, k in zip(group, anchor, windows, strict=True):
        x = rng.integers(0, 2, k + window - 1).astype(np.uint64)
        x[a : a + prefix] = [g + 10, g + 11, g + 12, g + 13]
        texts.append(x)
    got = deep_nodes(group, doc, anchor, windows, [x.tobytes() for x in texts], window)
    assert got.any()
    for i in range(n):
        for k in range(windows[i]):
            same = [doc[j] for j in range(n) if group[j] == group[i] and 0 <= (m := anchor[j] - anchor[i] + k) < windows[j] and (texts[j][m : m + window] == texts[i][k : k + window]).all()]
            assert got[i, k] == (min(same) < doc[i])


def test_repeats_of_repeated_ids(make, words):
    text = words(60)
    got = remove_repeats(make([(1, text), (1, text), (1, "other " + text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (1, 0), (2, 60)]


def test_repeats_of_a_row_given_many_times(make, words):
    """Rows of one document are one in the trees, and passages that it repeats itself are counted by rows."""
    text, other = words(70), words(60, 5)
    rows = [(1, text)] * 2000 + [(2, "own " + other + " end")] * 3 + [(0, " ".join(["x", words(55, 3)] * 40))]
    for group_rows in (1024, 30):
        got = remove_repeats(make(rows), group_rows=group_rows).collect()
        want = brute_repeats(list(dict(rows).items()))
        assert len(got) == len(rows) and {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == {(i, *v) for i, v in want.items()}


def test_repeats_empty(make):
    assert remove_repeats(make([])).collect() == []


def measures(text):
    w = re.findall(WORD, text or "")
    tri = list(zip(w, w[1:], w[2:], strict=False))
    n = Counter(tri)
    cover = {k + j for k, x in enumerate(tri) if n[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


@pytest.mark.parametrize("extra", [[], [(5, "same line\nsame line\n\nother # line\n same line"), (6, "a b c a b c d e a b"), (7, "k " * 3000)]])
def test_ledger(make, words, odd, extra):
    rows = corpus(words, odd) + extra
    book = judge(ledger(make(rows))).collect()
    assert len(book) == len(rows)
    want = Counter((i, *measures(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in book) == want
    for r in book:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_policies(make, words, odd):
    book = ledger(make(corpus(words, odd) + [(80, "ab ## " * 10 + words(80))])).cache()
    bits = [r.failures for r in book.collect()]
    whole = mask(POLICIES["v1"])
    for r in ablations(book).collect():
        bit = mask((r.rule,))
        assert (r.failed, r.alone, r.kept_without) == (sum(b & bit != 0 for b in bits), sum(b & whole == bit for b in bits), sum(b & (whole ^ bit) == 0 for b in bits))
    total = {(r.kept_old, r.kept_new): r.n for r in compare(book, "base", "v1").collect()}
    assert sum(total.values()) == len(bits) and (False, True) not in total


def test_filter_on_ledger_ends(make, words):
    """A filter above the ledger must not be pushed into its expressions."""
    rows = ledger(make([(1, words(5000)), (2, "a b")]), carry=True)
    assert [r.doc_id for r in judge(rows).where("kept").select("row.*").collect()] == [1]


def test_ledger_of_repeated_and_no_rows(make, words):
    """Repeated rows are judged each; a column named like a result doesn't get in; no rows give none."""
    text = words(60)
    book = judge(ledger(make([(1, text), (1, text), (1, "a b"), (None, text)]))).collect()
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in book) == [("1", 2, False), ("1", 60, True), ("1", 60, True), ("None", 60, True)]
    assert judge(ledger(make([]))).collect() == []
    assert [r.n for r in compare(ledger(make([])), "base", "v1").collect()] == []
