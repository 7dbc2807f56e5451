"""Packing, the BPE lexicon and licence scans: exact ids, valid packings, brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codestrata.llm.bpe import ByteLevelEncoder
from codestrata.llm.lexicon import Encoder, Lexicon, encode
from codestrata.llm.licenses import TEMPLATES, scan_licenses
from codestrata.llm.packing import Plan, pack

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "", " ", "a", " a", "a ", "a  b", "a \n b", "a\n\nb", "a\n b", "\n\na", "it's we'll 'S", "x<|endoftext|>y", "<|ENDOFTEXT|> <|startoftext|>A", "ÉCOLE Straße ÀÇ", "İstanbul ΣΑΣ ς", "é ́a",
    "a b c  d", "漢字 かな 한국어", "\x1c\x1d x\x1ey", "1234 5.6e7 #$%&&&", "🙂🙂 👩‍👩‍👧", "tab\tsep\x0bv\x0cf\rr", "word " * 300, "z" * 5000, "퟿ �",
]


def test_byte_level_ids_are_the_librarys():
    own, library = ByteLevelEncoder(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(5)
    pieces = ["a", "Word", " ", "  ", "\n", "\t", "'s", "é", "漢", "<|endoftext|>", "12", "!?", " ", "\x1c"]
    texts = HARD + ["".join(rng.choices(pieces, k=rng.randrange(1, 30))) for _ in range(400)]
    for text, together in zip(texts, ByteLevelEncoder(BYTE).encode(texts), strict=True):
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert own.encode([text])[0] == want == together, repr(text)


def test_files_with_other_patterns_go_to_the_library():
    """The word file is no byte-level one and the other way round: neither encoder may cut texts then."""
    library = Tokenizer.from_file(WORD)
    own = ByteLevelEncoder(WORD)
    assert not own.by_chunk
    assert own.encode(HARD) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in HARD]
    library = Tokenizer.from_file(BYTE)
    encoder = Encoder(BYTE, Lexicon.build({}))
    assert not encoder.by_word
    for text, (raw, decoded) in zip(HARD, encoder.encode(HARD), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert (raw, decoded) == (np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)), repr(text)


def test_memory_does_not_change_ids(monkeypatch):
    import codestrata.llm.bpe as bpe

    monkeypatch.setattr(bpe, "MEMORY", 20)
    own, library = ByteLevelEncoder(BYTE), Tokenizer.from_file(BYTE)
    for i in range(30):
        text = " ".join(f"w{(i * k) % 41}" for k in range(30))
        assert own.encode([text])[0] == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_lexicon_is_exact_and_minimal():
    rng = random.Random(2)
    words = {"".join(rng.choices("abc", k=rng.randrange(1, 7))).encode(): [rng.randrange(9) for _ in range(rng.randrange(1, 4))] for _ in range(300)}
    words |= {s + b"ing": [1] for s in (b"go", b"do", b"see")} | {"été".encode(): [3, 4]}
    lexicon = Lexicon.mapped(Lexicon.build(words))
    for w, k in zip(sorted(words), lexicon.numbers(sorted(words)), strict=True):
        assert list(lexicon.ids_of(k)) == words[w]
    absent = [w for w in (b"", b"zz", b"abcabcabc", b"goin", "ét".encode()) if w not in words]
    assert (lexicon.numbers(absent) == -1).all()
    rights = set()  # a minimal automaton has a state for each set of endings
    for w in words:
        for k in range(len(w) + 1):
            rights.add(frozenset(x[k:] for x in words if x.startswith(w[:k])))
    assert lexicon.states == len(rights)
    assert (Lexicon(Lexicon.build({})).numbers([b"a"]) == -1).all()


def test_word_level_ids_and_decoding(spark, make, odd):
    library = Tokenizer.from_file(WORD)
    rows = list(enumerate(HARD)) + [(i, t) for i, t in odd if i is not None] + [(0, "")]
    got = encode(make(rows), WORD).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.decoded == decoded, repr(text)
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert encode(make([]), WORD).collect() == []


def test_small_memory_of_the_encoder(monkeypatch):
    import codestrata.llm.lexicon as module

    monkeypatch.setattr(module, "MEMORY", 10)
    own, library = Encoder(WORD, Lexicon.build({b"w1": [int(x) for x in Tokenizer.from_file(WORD).encode("w1", add_special_tokens=False).ids]})), Tokenizer.from_file(WORD)
    texts = [" ".join(f"w{(i * k) % 23}" for k in range(20)) for i in range(20)]
    for text, (ids, _) in zip(texts, own.encode(texts), strict=True):
        assert ids == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("counts", [{}, {1024: 3}, {1: 5000}, {513: 7}, {600: 9, 424: 9}, "uniform", "middle"])
def test_plan(counts):
    rng = np.random.default_rng(4)
    if isinstance(counts, str):
        sizes = rng.integers(1, 1025, 20_000) if counts == "uniform" else rng.integers(200, 700, 9_000)
        counts = {int(a): int(b) for a, b in zip(*np.unique(sizes, return_counts=True), strict=True)}
    plan = Plan(counts)
    length = np.concatenate([np.full(n, x) for x, n in counts.items()] or [np.zeros(0, int)]).astype(int)
    rank = np.concatenate([np.arange(n) for n in counts.values()] or [np.zeros(0, int)]).astype(int)
    if not len(length):
        assert plan.sequences == 0
        return
    sequence, offset = plan.place(length, rank)
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], length[order]
    first = np.r_[True, s[1:] != s[:-1]]
    assert (o[first] == 0).all() and (o[1:][~first[1:]] == (o + n)[:-1][~first[1:]]).all() and (o + n).max() <= 1024
    least = max(-(-int(length.sum()) // 1024), int((length > 512).sum()))
    assert len(np.unique(s)) == plan.sequences <= least * 1.01 + 1


def test_pack(spark, make, words, odd):
    library = Tokenizer.from_file(BYTE)
    rows = [(i, words(17 * i + 1, i)) for i in range(40)] + [(50, words(3000)), (51, words(3000))] + odd + [(7, words(17 * 7 + 1, 7))]
    got = pack(make(rows), BYTE, keep_ids=True).collect()
    texts = dict(rows)
    docs = {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        docs.setdefault(r.doc_id, []).append(r)
    for i, pieces in docs.items():
        want = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        for r in pieces:
            assert bytes(r.ids) == want[4 * r.start : 4 * (r.start + r.length)]
        cuts = sorted({(r.piece, r.start, r.length) for r in pieces})
        assert [c[0] for c in cuts] == list(range(len(cuts))) and sum(c[2] for c in cuts) == len(want) // 4
        assert all(c[2] == 1024 for c in cuts[1:])
    assert set(docs) == set(texts)
    seats = {}
    for r in got:
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seats.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack(make([]), BYTE).collect() == []


def test_licenses(make, words, odd):
    rng = random.Random(9)
    rows = list(odd)
    for i, text in enumerate(TEMPLATES.values()):
        rows.append((i, f"{words(rng.randrange(400))} {text.upper() if i % 2 else text} {words(rng.randrange(400), 900)}"))
    long = TEMPLATES["mit-grant"].split()
    rows += [(20, words(3000) + " " + " ".join(long[:-4]) + " " + words(50)), (21, " ".join(long[: len(long) // 2])), (22, TEMPLATES["mit-line"] + " and again " + TEMPLATES["mit-line"])]
    got = {(r.doc_id, r.template) for r in scan_licenses(make(rows)).collect()}

    def shingles(text):
        import re

        w = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
        w = [x.lower() for x in w]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    want = {(i, name) for i, text in rows for name, t in TEMPLATES.items() if len(shingles(t) & shingles(text)) >= 0.8 * len(shingles(t))}
    assert got == want
    assert scan_licenses(make([])).collect() == []
    name, notice = next(iter(TEMPLATES.items()))
    twice = [(r.doc_id, r.template) for r in scan_licenses(make([(1, notice), (1, notice), (2, words(50_000) + " " + notice + " " + words(50_000, 60_000))])).collect()]
    assert sorted(t for t in twice if t[1] == name) == [(1, name), (1, name), (2, name)]
