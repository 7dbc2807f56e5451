"""Exact encoding with a memory of chunks, shared by packing and by BPE encoding."""

from __future__ import annotations

import json
import os
from array import array
from itertools import islice

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A worker remembers at most about so many chunks: memory stays bounded, results do not change.
MEMORY = 500_000
#: Characters that are split into chunks at a time, about.
SHARE = 1 << 20


def halved(known: dict) -> dict:
    """The earlier half of a memory: frequent chunks are met early, so they stay."""
    return dict(islice(known.items(), len(known) // 2))


class _Numbers(dict):
    """Chunks by number, in the order they are first asked for; new holds those since it was last emptied. 0 stands for all that can't be encoded alone."""

    def __init__(self, known: dict[str, int] | None = None):
        super().__init__(known or {"": 0})
        self.new: list[str] = []
        self.size = max(self.values()) + 1

    def __missing__(self, chunk: str) -> int:
        if chunk[0].isspace():
            self[chunk] = 0
            return 0
        self.new.append(chunk)
        n = self[chunk] = self.size
        self.size = n + 1
        return n


class ByteLevelEncoder:
    """``tokenizers`` with a byte-level BPE file, exactly, but each chunk between spaces is encoded once.

    A byte-level pattern always breaks before a space that follows a non-space,
    so a text is the concatenation of its chunks' encodings, each chunk with the
    space before it. That fails only where white space touches the space (an
    empty chunk, or one that begins with white space) or where a special token's
    string occurs; such texts are encoded whole, and so is every text if the
    file has a normaliser or other pre-tokens than plain byte-level ones.

    The new chunks of many texts are learned together: JOINED of them are one
    text to the library, and its ids are cut before every token that begins with
    the space.
    """

    JOINED = 1000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        first = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)
        self.by_chunk = plain and self.tokenizer.normalizer is None and not any(t.lstrip or t.rstrip for t in added)
        names = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.spaced = np.fromiter((n.startswith("\u0120") for n in names), bool)
        self.heads: dict[str, bytes] = {}
        self.numbers = _Numbers()
        self.ids: list[bytes | None] = [None]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        for begin in range(0, len(chunks), self.JOINED):
            part = chunks[begin : begin + self.JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = (4 * np.append(np.flatnonzero(self.spaced[ids]), len(ids))).tolist()
            raw = ids.tobytes()
            self.ids += [raw[i:j] for i, j in zip(at, at[1:])] if len(at) == len(part) + 1 else self._ids([" " + c for c in part])  # noqa: B905

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. Shares of about SHARE characters are worked on at a time: a chunk is many times its text's size."""
        out: list[bytes] = []
        begin = held = 0
        for end, text in enumerate(texts, 1):
            held += len(text)
            if held >= SHARE or end == len(texts):
                out += self._encoded(texts[begin:end])
                begin, held = end, 0
        return out

    def _encoded(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return self._ids(texts)
        rows = [None if any(s in t for s in self.special) else t.split(" ") for t in texts]
        new = list({chunks[0] for chunks in rows if chunks is not None} - self.heads.keys())
        self.heads.update(zip(new, self._ids(new), strict=True))
        found = [chunks and (chunks[0], list(map(self.numbers.__getitem__, chunks[1:]))) for chunks in rows]
        del rows
        self._learn(self.numbers.new)
        self.numbers.new.clear()
        out = []
        for text, parts in zip(texts, found, strict=True):
            if not text:
                out.append(b"")
            elif parts is None or (not parts[0] and parts[1]) or 0 in parts[1]:
                out.append(self._ids([text])[0])
            else:
                out.append(self.heads[parts[0]] + b"".join(map(self.ids.__getitem__, parts[1])))
        if len(self.heads) > MEMORY // 10:
            self.heads.clear()
        if len(self.ids) > MEMORY:
            self.ids = self.ids[: MEMORY // 2]
            self.numbers = _Numbers({c: n for c, n in self.numbers.items() if n < MEMORY // 2})
        return out


_encoders: dict[str, ByteLevelEncoder] = {}


def byte_level(path: str) -> ByteLevelEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = ByteLevelEncoder(path)
    return _encoders[path]
