"""Conversation structure repair by dynamic programming over a prefix trie (operator 13).

A conversation should read ``(s?(ua)+)?`` by the first letters of its roles. Its
cheapest repair keeps, reroles, deletes and inserts rows; which ones depends only
on its *signature*, a letter a row for role and fault. Distinct signatures are
sorted and walked as a prefix trie: the layer of a node (cost and edits by state
of the pattern) is computed once for all signatures below it, and read off where
a signature ends.

A conversation may be of any length. Rows are dealt by range of (conversation,
place), so one that holds a third of all rows lies on many tasks, and cut into
segments of SEGMENT rows at most. Costs and edits from each state to each other
one make up a small matrix per segment; matrices of one conversation combine in
order, the strings least in cost and then in ASCII, because edits of the same
rows at the same cost are never one another's prefix. Most conversations are one
segment and need no matrix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, stored

#: Rows of a segment, and about the characters of its texts, at most; a longer text is a segment of its own.
SEGMENT, SEGMENT_CHARS = 256, 1 << 20
#: Records of an Arrow batch that goes back, and about their characters.
BATCH, BATCH_CHARS = 512, 1 << 22

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: States of the pattern: nothing yet, after s, after u, after a. Where a user or assistant row leads, and its role.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}

Layer = list  # of (cost, edits) or None, by state


# --- damage -----------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults put in, by crc32 of ``conv_id:turn`` modulo 20: 0 dropped, 1 emptied, 2 without sentence ends, 3 twice, 4 role user. A null is one space."""
    name = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:-1])
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    code = F.col("code")
    d = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("code")).where("code <> 0")
    d = d.withColumn("text", F.when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    d = d.withColumn("role", F.when(code == 4, "user").otherwise(F.col("role")))
    return d.select("conv_id", "turn", "role", "text", F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


# --- segments ---------------------------------------------------------------


def _flagged(rows: DataFrame) -> DataFrame:
    """Rows with a number of their own, whether their role and text were there before in the conversation, and whether they are blank or break off."""
    text = F.col("text")
    ends = F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)
    base = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    base = base.withColumns({"digest": F.md5(text), "blank": ends == "", "cut": (ends != "") & ~ends.isin(".", "!", "?"), "salt": F.monotonically_increasing_id()})
    base = stored(base, "turns")
    place = F.struct("turn", "salt")
    twins = base.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    twins = stored(twins.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"), "twins")
    joined = base.join(twins, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    return joined.withColumn("again", F.coalesce(place > F.col("first"), F.lit(False))).drop("c", "r", "d", "first")


_SEGMENT = (
    "part int, seg long, conv_id {id}, open boolean, signature string, roles array<string>, texts array<string>, first string, last string,"
    " illegal long, blank long, duplicate long, truncated long, low long, high long, turns long"
)


class _Cutter:
    """Gathers rows in order into segments; a conversation known whole as one segment is not open."""

    def __init__(self, part: int, schema: pa.Schema, most: int):
        self.part, self.schema, self.most, self.seg = part, schema, most, 0
        self.rows: list[tuple] = []
        self.chars, self.conv, self.alone = 0, None, False
        self.out: list[dict] = []
        self.out_chars = 0

    def add(self, conv, turn, role, text, again, blank, cut):
        if self.rows and conv != self.conv:
            self.close(ended=True)
            self.alone = True  # the next begins here
        elif self.rows and (len(self.rows) >= self.most or self.chars + len(text) > SEGMENT_CHARS):
            self.close(ended=False)
            self.alone = False
        self.conv = conv
        self.rows.append((turn, role, text, "blank" if blank else "duplicate" if again else "truncated" if cut else ""))
        self.chars += len(text)

    def close(self, ended: bool):
        rows, self.rows, self.chars = self.rows, [], 0
        letters = [r[1][:1] for r in rows]
        own = [x if x in ("s", "u", "a") else "o" for x in letters]
        faults = [r[3] for r in rows]
        turns = [r[0] for r in rows if r[0] is not None]
        self.out.append(
            {
                "part": self.part, "seg": self.seg, "conv_id": self.conv, "open": not (ended and self.alone),
                "signature": "".join("D" if f in ("blank", "duplicate") else x.upper() if f else x for x, f in zip(own, faults, strict=True)),
                "roles": [r[1] for r in rows], "texts": [r[2] for r in rows], "first": letters[0], "last": letters[-1],
                "illegal": sum(a + b not in LEGAL for a, b in zip(letters, letters[1:])),
                "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
                "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
            }
        )
        self.seg += 1
        self.out_chars += sum(len(r[2]) for r in rows)

    def full(self) -> bool:
        return len(self.out) >= BATCH or self.out_chars >= BATCH_CHARS

    def batch(self) -> pa.RecordBatch:
        out, self.out, self.out_chars = self.out, [], 0
        return pa.RecordBatch.from_pylist(out, self.schema)


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """The segments of all conversations, numbered in order by (part, seg), with signature, faults and what they keep count of."""
    # ties of a turn: by role, then by text; 64 characters and a digest of it stand for the whole
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), "digest", "salt"]
    dealt = _flagged(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    id_type = dealt.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    texts = pa.list_(pa.string())
    kinds = {"part": pa.int32(), "conv_id": to_arrow_type(id_type), "open": pa.bool_(), "roles": texts, "texts": texts} | dict.fromkeys(("signature", "first", "last"), pa.string())
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in (c.split()[0] for c in _SEGMENT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(TaskContext.get().partitionId(), schema, most)
        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "again", "blank", "cut")), strict=True):
                cutter.add(*row)
                if cutter.full():
                    yield cutter.batch()
        if cutter.rows:
            cutter.close(ended=False)  # it may go on in the next part
        if cutter.out:
            yield cutter.batch()

    columns = ["conv_id", "turn", "role", "text", "again", "blank", "cut"]
    return stored(dealt.select(columns).mapInArrow(run, _SEGMENT.format(id=id_type.simpleString())), "segments")


# --- the trie ---------------------------------------------------------------


def _least(a, b):
    return b if a is None or b is not None and b < a else a


def inserted(layer: Layer) -> Layer:
    """The layer with rows inserted wherever that is cheaper: two at most, more lead where fewer do."""
    for _ in range(2):
        layer = [*layer]
        for p, found in enumerate([*layer]):
            if found:
                layer[NEXT[p]] = _least(layer[NEXT[p]], (found[0] + INSERT, found[1] + "I"))
    return layer


def step(layer: Layer, letter: str) -> Layer:
    """The layer after one more row."""
    out: Layer = [None] * 4
    own, late = letter.lower(), CUT * letter.isupper()
    for p, found in enumerate(layer):
        if found is None:
            continue
        cost, edits = found
        out[p] = _least(out[p], (cost + DELETE, edits + "D"))
        if letter == "D":
            continue
        if (own, p) in KEPT:
            out[KEPT[own, p]] = _least(out[KEPT[own, p]], (cost + KEEP + late, edits + "K"))
        out[NEXT[p]] = _least(out[NEXT[p]], (cost + REROLE + late, edits + "R"))
    return inserted(out)


def start(state: int) -> Layer:
    return inserted([(0, "") if p == state else None for p in range(4)])


class Trie:
    """The path from the root to the signature at hand, with a layer for each start at every node. Signatures come sorted."""

    def __init__(self, starts: tuple[int, ...]):
        self.path, self.layers, self.computed = "", [[start(p) for p in starts]], 0

    def layers_of(self, signature: str) -> list[Layer]:
        shared = 0
        while shared < min(len(self.path), len(signature)) and self.path[shared] == signature[shared]:
            shared += 1
        del self.layers[shared + 1 :]
        for letter in signature[shared:]:
            self.layers.append([step(layer, letter) for layer in self.layers[-1]])
            self.computed += 1
        self.path = signature
        return self.layers[-1]


def ended(layer: Layer) -> tuple[int, str]:
    return min(layer[q] for q in ENDS if layer[q])


def solve(signatures: DataFrame) -> DataFrame:
    """(open, signature, cost, edits, moves) of distinct (open, signature): the whole repair, or for open ones the matrix of moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {False: Trie((0,)), True: Trie((0, 1, 2, 3))}
        for b in batches:
            out = []
            for is_open, signature in zip(b["open"].to_pylist(), b["signature"].to_pylist(), strict=True):
                layers = tries[is_open].layers_of(signature)
                cost, edits = (None, None) if is_open else ended(layers[0])
                moves = [{"p": p, "q": q, "cost": m[0], "edits": m[1]} for p, layer in enumerate(layers) for q, m in enumerate(layer) if m] if is_open else []
                out.append({"open": is_open, "signature": signature, "cost": cost, "edits": edits, "moves": moves})
            yield pa.RecordBatch.from_pylist(out, schema)

    move = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
    schema = pa.schema([("open", pa.bool_()), ("signature", pa.string()), ("cost", pa.int64()), ("edits", pa.string()), ("moves", pa.list_(move))])
    dealt = signatures.distinct().repartitionByRange("open", "signature").sortWithinPartitions("open", "signature")
    return stored(dealt.mapInArrow(run, "open boolean, signature string, cost long, edits string, moves array<struct<p int, q int, cost long, edits string>>"), "solved")


# --- whole conversations ----------------------------------------------------


def combined(matrices: Iterator[list[dict]]) -> tuple[int, list[tuple[int, int]]]:
    """(cost, [(state before, state after) of each segment]) of the least repair. What all candidates begin with is dropped as they go."""
    layer: Layer = [(0, ""), None, None, None]
    back: list[tuple] = []
    for moves in matrices:
        new: Layer = [None] * 4
        came = [None] * 4
        for m in moves:
            if layer[m["p"]]:
                found = (layer[m["p"]][0] + m["cost"], layer[m["p"]][1] + m["edits"])
                if new[m["q"]] is None or found < new[m["q"]]:
                    new[m["q"]], came[m["q"]] = found, m["p"]
        back.append(tuple(came))
        tails = [x[1] for x in new if x]
        shared, low, high = 0, min(tails), max(tails)
        while shared < len(low) and low[shared] == high[shared]:
            shared += 1
        layer = [x and (x[0], x[1][shared:]) for x in new]
    (cost, _), q = min((layer[q], q) for q in ENDS if layer[q])
    out = []
    for came in reversed(back):
        out.append((came[q], q))
        q = came[q]
    return cost, out[::-1]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, iterator of its rows as dicts) from batches sorted by conversation; nothing is gathered."""
    rows = (row for b in batches for row in b.to_pylist())
    return groupby(rows, key=lambda r: r["conv_id"])


def _chosen(parts: DataFrame) -> DataFrame:
    """(part, seg, p, q): the states between which the segments of open conversations lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, rows in _in_order(batches):
            at: list[tuple] = []

            def moves(rows=rows, at=at):
                for r in rows:
                    at.append((r["part"], r["seg"]))
                    yield r["moves"]

            _, states = combined(moves())
            out += [{"part": a, "seg": s, "p": p, "q": q} for (a, s), (p, q) in zip(at, states, strict=True)]
            while len(out) >= BATCH:
                yield pa.RecordBatch.from_pylist(out[:BATCH], schema)
                out = out[BATCH:]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("part", pa.int32()), ("seg", pa.int64()), ("p", pa.int32()), ("q", pa.int32())])
    dealt = parts.select("conv_id", "part", "seg", "moves").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    return stored(dealt.mapInArrow(run, "part int, seg long, p int, q int"), "chosen")


def repaired(state: int, edits: str, roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the rows that the edits leave, from a state of the pattern on."""
    out, i = [], 0
    for e in edits:
        if e == "I":
            out.append((e, ROLE[state], ""))
            state = NEXT[state]
            continue
        if e == "K":
            out.append((e, roles[i], texts[i]))
            state = KEPT[roles[i][:1], state]
        elif e == "R":
            out.append((e, ROLE[state], texts[i]))
            state = NEXT[state]
        i += 1
    return out


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Segments of the repaired conversations, in order by (conv_id, part, seg): cost, edits and ``repaired`` rows (edit, role, text), and the faults found.

    Rows are taken by turn, null first; rows of one turn by role, then by text (its
    first 64 characters, then a digest). A null role or text is one space, so such
    a text is blank; null conversation ids are one conversation. A row's first
    fault counts: blank, duplicate (role and text seen earlier in the
    conversation), truncated (its last character that is no white space doesn't
    end a sentence). Repeated rows are duplicates. Edits: K keeps, R gives the
    role that is due (2), D deletes (3; the only one for blank and duplicate rows),
    I inserts an empty row of the role that is due (2); a truncated row that stays
    adds 1. Of the cheapest edits those that are least in ASCII. Texts of any
    length are carried whole. Other columns are not read. No rows give no rows.
    """
    bounded(rows.sparkSession)
    s = segments(rows, segment)
    solved = solve(s.select("open", "signature")).withColumnsRenamed({"open": "o", "signature": "g"})
    answers = s.join(solved, (F.col("open") == F.col("o")) & (F.col("signature") == F.col("g")))
    whole = answers.where("not open").select(*s.columns, F.lit(0).alias("p"), "cost", "edits")
    chosen = _chosen(s.where("open").select("conv_id", "part", "seg", "open", "signature").join(solved, (F.col("open") == F.col("o")) & (F.col("signature") == F.col("g"))))
    move = F.filter("moves", lambda m: (m["p"] == F.col("p")) & (m["q"] == F.col("q")))[0]
    cut = answers.where("open").join(chosen, ["part", "seg"]).withColumn("move", move).select(*s.columns, "p", F.col("move.cost").alias("cost"), F.col("move.edits").alias("edits"))

    kept = [c for c in s.columns if c not in ("signature", "roles", "texts")] + ["cost", "edits"]
    row = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [[dict(zip(("edit", "role", "text"), r, strict=True)) for r in repaired(*x)] for x in zip(*(b[c].to_pylist() for c in ("p", "edits", "roles", "texts")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(done, pa.list_(row))], [*kept, "repaired"])

    both = whole.unionByName(cut)
    schema = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in kept)
    return both.mapInArrow(run, f"{schema}, repaired array<struct<edit string, role string, text string>>")


def repaired_rows(repaired: DataFrame) -> DataFrame:
    """(conv_id, part, seg, place, edit, role, text): one row for each that is left, in order by part, seg and place."""
    return repaired.select("conv_id", "part", "seg", F.posexplode("repaired").alias("place", "row")).select("conv_id", "part", "seg", "place", "row.*")


def _line(row: Column) -> Column:
    return F.concat(row["role"], F.lit(":"), row["text"])


_DIGEST = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(conversations: DataFrame, repaired: DataFrame) -> DataFrame:
    """One row for each conversation of ``conversations``: its gaps, faults, cost, edits (``audit``) and the sha256 of its repaired lines.

    A conversation of one segment is hashed where it lies. Of longer ones a task
    reads the segments in order, one at a time: sha256 has no other way. A number
    of gaps beyond a long is null.
    """
    span = (F.col("high").cast("decimal(38,0)") - F.col("low").cast("decimal(38,0)") + 1 - F.col("turns")).try_cast("long")
    digest = F.sha2(F.array_join(F.transform("repaired", _line), "\n"), 256)
    whole = repaired.where("not open").select("conv_id", F.coalesce(span, F.when(F.col("turns") == 0, 0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.col("edits").alias("audit"), digest.alias("repaired_sha256"))

    id_type = repaired.schema["conv_id"].dataType.simpleString()
    names = [c.split()[0] for c in _DIGEST.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {"conv_id": to_arrow_type(repaired.schema["conv_id"].dataType), "audit": pa.string(), "repaired_sha256": pa.string()}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, rows in _in_order(batches):
            out, sha, edits, lines = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0), hashlib.sha256(), [], 0
            last, low, high, turns = None, None, None, 0
            for r in rows:
                for k in out:
                    out[k] += r[k]
                out["illegal"] += last is not None and last + r["first"] not in LEGAL
                last = r["last"]
                if r["turns"]:
                    turns += r["turns"] - (high is not None and high == r["low"])
                    low, high = r["low"] if low is None else low, r["high"]
                edits.append(r["edits"])
                for x in r["repaired"]:
                    sha.update(("\n" * bool(lines) + x["role"] + ":" + x["text"]).encode())
                    lines += 1
            gaps = high - low + 1 - turns if turns else 0
            out |= {"conv_id": conv, "gaps": gaps if gaps < 1 << 63 else None, "audit": "".join(edits), "repaired_sha256": sha.hexdigest()}
            yield pa.RecordBatch.from_pylist([out], schema)

    columns = ["conv_id", "part", "seg", "first", "last", "illegal", "blank", "duplicate", "truncated", "low", "high", "turns", "cost", "edits", "repaired"]
    dealt = repaired.where("open").select(columns).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    found = whole.unionByName(dealt.mapInArrow(run, _DIGEST.format(id=id_type))).withColumnRenamed("conv_id", "c")
    ids = conversations.select("conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.when(F.col("audit").isNull(), 0).otherwise(F.col("gaps")).cast("long").alias("gaps")
    empty = hashlib.sha256(b"").hexdigest()
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", gaps, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
