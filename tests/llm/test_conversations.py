"""Operator 13 against a version that tries all edits, and one that searches them, on small tables."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest

from codestrata.llm import conversations as C


def faults_of(rows):
    """rows: (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def run_edits(rows, faults, edits):
    """(cost, repaired) or None where the edits don't fit."""
    i = cost = 0
    out = []
    due = lambda: "assistant" if out and out[-1][0][:1] == "u" else "user"
    for e in edits:
        if e == "I":
            out.append((due(), ""))
            cost += 2
            continue
        if i == len(rows):
            return None
        _, role, text = rows[i]
        if e == "D":
            cost += 3
        elif faults[i] in ("blank", "duplicate"):
            return None
        else:
            out.append((role if e == "K" else due(), text))
            cost += 2 * (e == "R") + (faults[i] == "truncated")
        i += 1
    if i < len(rows) or not re.fullmatch("(s?(ua)+)?", "".join((r[:1] or "_") for r, _ in out)):
        return None
    return cost, out


def tried(rows, faults):
    """All edit strings of up to three inserts."""
    best = None
    for n in range(len(rows), len(rows) + 4):
        for edits in product("DIKR", repeat=n):
            if edits.count("I") == n - len(rows) and (found := run_edits(rows, faults, edits)):
                best = min(best or (99, ""), (found[0], "".join(edits)))
    return best


def searched(rows, faults):
    """The least (cost, edits) by a search in order of both."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, edits, i, q = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, edits
        if (i, q) in done:
            continue
        done.add((i, q))
        nxt = 3 if q == 2 else 2
        heapq.heappush(heap, (cost + 2, edits + "I", i, nxt))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, q))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                heapq.heappush(heap, (cost + 2 + late, edits + "R", i + 1, nxt))
                to = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}.get(rows[i][1][:1])
                if to:
                    heapq.heappush(heap, (cost + late, edits + "K", i + 1, to))


def plain(conversations, harm=True):
    by = {}
    for conv, turn, role, text in conversations:
        rows = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if harm else 19
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            rows += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, rows in by.items():
        rows.sort(key=lambda r: ((r[0] is not None, r[0] or 0), *(x.encode() for x in r[1:])))
        faults = faults_of(rows)
        cost, edits = searched(rows, faults)
        kept = run_edits(rows, faults, edits)[1]
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps if gaps < 1 << 63 else None, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, sha))
    return sorted(map(repr, out))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn long, role string, text string, seg int, audit string").repartition(3)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    return sorted(repr(tuple(r)) for r in df.select(COLUMNS).collect())


def invented(n, longest, seed=4):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", "Yes. ", "é 漢.", "?\x1c", "long " * 300 + "."]
    roles = ["user", "assistant", "system", "tool", "", "ua", None]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(longest)):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, None if rng.random() < 0.03 else turn + (rng.random() < 0.1), role, None if rng.random() < 0.05 else rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}."))
    return rows


ODD = [
    (None, None, None, None), (None, 3, "user", "Hi."), (500, None, "user", "a."), (500, None, "assistant", "b."), (501, -(2**63), "user", "a."), (501, 2**63 - 1, "assistant", "b."),
    *[(502, 4, "user", "Again.")] * 7, *[(503, 4, r, t) for r in ("user", "assistant") for t in ("b.", "a.", "ab.")],
]


def test_search_is_what_trying_all_finds():
    rng = random.Random(2)
    for _ in range(60):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", "c", ""])) for i in range(rng.randrange(5))]
        assert searched(rows, faults_of(rows)) == tried(rows, faults_of(rows))


def test_layers_are_shared_and_give_the_least_edits():
    rng = random.Random(3)
    signatures = sorted({"".join(rng.choice("DsuaoSUAO" if rng.random() < 0.4 else "ua") for _ in range(rng.randrange(9))) for _ in range(400)})
    trie = C.Trie((0,))
    for s in signatures:
        rows = [(0, {"s": "s", "u": "u", "a": "a"}.get(x.lower(), "o"), "") for x in s]
        faults = ["blank" if x == "D" else "truncated" if x.isupper() else "" for x in s]
        assert C.ended(trie.layers_of(s)[0]) == searched(rows, faults)
    assert trie.computed == len({s[:i] for s in signatures for i in range(1, len(s) + 1)}) < sum(map(len, signatures))


@pytest.mark.parametrize("segment", [256, 3, 1])
def test_conversations(spark, segment):
    rows = invented(60, 12) + ODD
    df = frame(spark, rows)
    assert got(C.digests(df, C.repair(C.damage(df), segment))) == plain(rows)


def test_a_conversation_that_is_most_of_the_table(spark):
    rng = random.Random(8)
    rows = invented(20, 6) + [(77, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"{t}.", "open"])) for t in range(1500)]
    df = frame(spark, rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        repaired = C.repair(C.damage(df), 64).cache()
        assert repaired.where("conv_id = 77").select("part").distinct().count() > 1  # several tasks had it
        assert got(C.digests(df, repaired)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_as_they_are(spark):
    """Without damage; a clean conversation stays as it is, rows come back in order."""
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (2, 0, "user", "Hi!"), (2, 1, "user", "Hi!"), (3, 0, "system", "s.")]
    df = frame(spark, rows)
    repaired = C.repair(df).cache()
    assert got(C.digests(df, repaired)) == plain(rows, harm=False)
    lines = C.repaired_rows(repaired).orderBy("conv_id", "part", "seg", "place").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in lines] == [
        (1, "K", "system", "Be kind."), (1, "K", "user", "Hi!"), (1, "K", "assistant", "Hello."), (2, "K", "user", "Hi!"), (2, "I", "assistant", ""),
    ]


def test_all_rows_dropped_or_none(spark):
    gone = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    for rows in ([(*gone, "user", "Hi.")], []):
        df = frame(spark, rows)
        assert got(C.digests(df, C.repair(C.damage(df)))) == plain(rows)


def test_matrices_combine_like_one_walk():
    rng = random.Random(6)
    for _ in range(200):
        s = "".join(rng.choice("DsuaoSUAOuaua") for _ in range(rng.randrange(1, 14)))
        cuts = sorted(rng.sample(range(1, len(s)), rng.randrange(min(4, len(s))))) if len(s) > 1 else []
        parts = [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]
        matrices = [[{"p": p, "q": q, "cost": m[0], "edits": m[1]} for p, layer in enumerate(C.Trie((0, 1, 2, 3)).layers_of(x)) for q, m in enumerate(layer) if m] for x in parts]
        cost, states = C.combined(iter(matrices))
        edits = "".join(next(m["edits"] for m in matrix if (m["p"], m["q"]) == pq) for matrix, pq in zip(matrices, states, strict=True))
        assert (cost, edits) == C.ended(C.Trie((0,)).layers_of(s)[0])
