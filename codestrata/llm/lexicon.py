"""BPE encoding and decoding through a minimal acyclic transducer lexicon (operator 10).

Frequent words of the corpus are compiled, with their ids, into a minimal
acyclic automaton: equal suffixes share their states. Each arc carries how many
lexicon words sort before the ones behind it, so the sum along a path is the
word's number, and the number selects its ids. The automaton is a few arrays;
a worker writes them once to an unnamed temporary file and maps it.

Texts are cut into chunks between ``\\x20\\x09-\\x0D``: the tokenizer's pattern never
matches across white space and its normaliser (NFC, white space, lower case)
never looks across it, so a text's ids are its chunks' ids in order. Chunks
are cut by the pattern into words; those outside the lexicon are merged exactly
by the ``tokenizers`` library.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import halved
from .shared import bounded, stored

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words compiled into the lexicon, which bounds what is collected and sent out.
LEXICON_WORDS = 50_000
#: Longer chunks are never compiled.
LONGEST = 64
#: Chunks that a worker remembers.
MEMORY = 400_000
#: Texts whose new chunks are learned together.
TOGETHER = 100

RESULT = "doc_id long, n_tokens long, ids binary, decoded string, ids_sha256 string, decoded_sha256 string"


class Lexicon:
    """A minimal acyclic transducer from words (UTF-8) to id sequences, as one block of bytes."""

    _PARTS = (("keys", np.int64), ("target", np.int32), ("before", np.int32), ("final", np.uint8), ("first", np.int64), ("ids", np.uint32))

    def __init__(self, data):
        sizes = np.frombuffer(data, np.int64, len(self._PARTS))
        at = 8 * len(self._PARTS)
        for (name, kind), size in zip(self._PARTS, sizes, strict=True):
            setattr(self, name, np.frombuffer(data, kind, int(size), at))
            at += -(-int(size) * np.dtype(kind).itemsize // 8) * 8

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> bytes:
        """Compiles words in sorted order, freezing each state once no later word can change it."""
        register: dict[tuple, int] = {}
        arcs: list[tuple[tuple[int, int], ...]] = []
        final: list[int] = []
        counts: list[int] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(arcs)
                arcs.append(key[1])
                final.append(node[0])
                counts.append(node[0] + sum(counts[t] for _, t in key[1]))
            return register[key]

        path: list[list] = [[0, []]]  # of the last word: [is a word, finished arcs]
        last = b""
        ordered = sorted(words)
        for word in ordered:
            same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))  # noqa: B905
            while len(path) > same + 1:
                state = freeze(path.pop())
                path[-1][1].append((last[len(path) - 1], state))
            path += [[0, []] for _ in word[same:]]
            path[-1][0] = 1
            last = word
        while len(path) > 1:
            state = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], state))
        root = freeze(path[0])

        order = {root: 0} | {s: i + (s < root) for i, s in enumerate(range(len(arcs))) if s != root}
        rows = []
        for s, out in enumerate(arcs):
            before = final[s]
            for label, t in out:
                rows.append((order[s] * 256 + label, order[t], before))
                before += counts[t]
        rows.sort()
        ends = np.zeros(len(arcs), np.uint8)
        for s, i in order.items():
            ends[i] = final[s]
        ids = [words[w] for w in ordered]
        values = {
            "keys": [r[0] for r in rows], "target": [r[1] for r in rows], "before": [r[2] for r in rows], "final": ends,
            "first": np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else [0], "ids": [x for y in ids for x in y],
        }
        parts = [np.asarray(values[name], dtype=kind) for name, kind in cls._PARTS]
        pad = lambda b: b + bytes(-len(b) % 8)
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(pad(p.tobytes()) for p in parts)

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """The same, from a memory-mapped file without a name, which is gone when the worker ends."""
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 where it is not in the lexicon. All words step through the automaton together."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        size = np.fromiter(map(len, words), np.int64, n)
        begin = np.cumsum(size) - size
        live, state, total = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        step = 0
        while len(live):
            done = size[live] == step
            ended = live[done]
            out[ended] = np.where(self.final[state[done]] == 1, total[done], -1)
            live, state, total = live[~done], state[~done], total[~done]
            key = state * 256 + data[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, at = live[hit], at[hit]
            state, total = self.target[at].astype(np.int64), total[hit] + self.before[at]
            step += 1
        return out

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.first[number] : self.first[number + 1]]

    @property
    def states(self) -> int:
        return len(self.final)


def _chunks(text: str) -> list[str]:
    for blank in "\n\t\x0b\x0c\r":
        if blank in text:
            text = text.replace(blank, " ")
    return text.split(" ")


#: The file's pattern and normalisers, which the cutting of chunks and words below relies on.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Chunks of visible ASCII and the letters of Latin-1, where case and composition are settled; others go to the library whole.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: The file's own pre-tokens of such a chunk, lower-cased.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def _plain(chunk: str) -> bool:
    return _PLAIN.fullmatch(chunk) is not None and "<|" not in chunk  # a special token's string is no word


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        words: Counter = Counter()
        for chunk, n in held.items():
            if _plain(chunk):
                for w in _WORDS.findall(chunk):
                    words[w] += n
        kept = [w for w in words if len(w) <= LONGEST]
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([words[w] for w in kept], pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(_chunks(text.lower()))
            if len(held) > MEMORY:
                yield out()
                held.clear()
    if held:
        yield out()


def cuts_words(tokenizer) -> bool:
    """Whether a tokenizer normalises and cuts as _chunks and _WORDS do, and decodes by joining tokens with a space."""
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None or tokenizer.decoder is not None:
        return False
    split = [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]
    normal, pre = (json.loads(x.__getstate__()) for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    return normal == {"type": "Sequence", "normalizers": NORMALIZERS} and pre == {"type": "Sequence", "pretokenizers": split}


class Encoder:
    """Ids and token strings of chunks: remembered, from the lexicon, or merged by the library."""

    def __init__(self, path: str, data: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = cuts_words(self.tokenizer)
        self.lexicon = Lexicon.mapped(data)
        self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[str, tuple[bytes, str]] = {"": (b"", "")}
        self.words: dict[str, tuple[bytes, str]] = {}

    def _entry(self, ids: list[int]) -> tuple[bytes, str]:
        return array("I", ids).tobytes(), " ".join([self.names[i] for i in ids])

    def _merge(self, texts: list[str], into: dict) -> None:
        for t, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            into[t] = self._entry(e.ids)

    def _learn(self, chunks: list[str]) -> None:
        parts = {c: _WORDS.findall(c.lower()) for c in chunks if _plain(c)}
        unseen = list({w for ws in parts.values() for w in ws if w not in self.words})
        numbers = self.lexicon.numbers([w.encode() for w in unseen]).tolist()
        for w, k in zip(unseen, numbers, strict=True):
            if k >= 0:
                self.words[w] = self._entry(self.lexicon.ids_of(k).tolist())
        self._merge([w for w, k in zip(unseen, numbers, strict=True) if k < 0], self.words)
        for c, ws in parts.items():
            if len(ws) == 1:
                self.known[c] = self.words[ws[0]]
            else:
                found = [self.words[w] for w in ws]
                self.known[c] = b"".join([x[0] for x in found]), " ".join([x[1] for x in found])
        self._merge([c for c in chunks if c not in parts], self.known)

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids (little-endian unsigned 32 bits) and decoded text of each text. Texts are taken some at a time, so that what is new in them is learned at once."""
        if not self.by_word:  # another kind of file: the library alone
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                yield array("I", e.ids).tobytes(), self.tokenizer.decode(e.ids, skip_special_tokens=False)
            return
        for begin in range(0, len(texts), TOGETHER):
            rows = [_chunks(t) for t in texts[begin : begin + TOGETHER]]
            new = {c for chunks in rows for c in chunks}.difference(self.known)
            if new:
                self._learn(list(new))
            for chunks in rows:
                found = list(map(self.known.__getitem__, chunks))
                yield b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[1]])
            if len(self.known) > MEMORY:
                self.known = halved(self.known)
            if len(self.words) > MEMORY:
                self.words = halved(self.words)


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, data: bytes) -> Encoder:
    key = path, hashlib.md5(data).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, data)
    return _encoders[key]


def _encode(batches: Iterator[pa.RecordBatch], path: str, sent, keep: bool) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, sent.value)
    names = [f.split()[0] for f in RESULT.split(", ")]
    for batch in batches:
        n, ids, decoded, a, b = [], [], [], [], []
        for raw, text in encoder.encode([t or "" for t in batch.column(1).to_pylist()]):
            n.append(len(raw) // 4)
            ids.append(raw if keep else None)
            decoded.append(text if keep else None)
            a.append(hashlib.sha256(raw).hexdigest())
            b.append(hashlib.sha256(text.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in ((n, pa.int64()), (ids, pa.binary()), (decoded, pa.string()), (a, pa.string()), (b, pa.string())))], names=names)


def compile_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """The transducer of the most frequent words of all texts: whole grades of frequency, ``words`` words at most."""
    from tokenizers import Tokenizer

    counts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "words")
    grade = F.floor(F.log2("n") * 16).cast("int")
    left, least = words, None  # a few hundred grades at most, so what comes to the driver never grows with the corpus
    for r in sorted(counts.groupBy(grade.alias("grade")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.grade):
        if r.n > left:
            break
        left, least = left - r.n, r.grade
    top = [r.word for r in counts.where(grade >= least).select("word").collect()] if least is not None else []
    library = Tokenizer.from_file(tokenizer)
    library.no_truncation()
    library.no_padding()
    return Lexicon.build({w.encode(): e.ids for w, e in zip(top, library.encode_batch_fast(top, add_special_tokens=False), strict=True)})


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, decoded, ids_sha256, decoded_sha256.

    As the ``tokenizers`` library with the file ``tokenizer``,
    add_special_tokens=False, no truncation or padding; decoded is its
    decode(ids, skip_special_tokens=False). Without ``keep``, ids and decoded
    are null and only their digests are made. A file that cuts words by another
    pattern than this module knows is left to the library whole.

    Null or empty text: no ids, decoded ''. Texts of any length are encoded whole. Repeated rows and null ids give a
    row each. Other columns are ignored. No rows give no rows.
    """
    bounded(docs.sparkSession)
    data = compile_lexicon(docs, tokenizer, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(data)  # at most LEXICON_WORDS words of LONGEST characters
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(lambda it: _encode(it, tokenizer, sent, keep), RESULT)
