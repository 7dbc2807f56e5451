"""Vectorised word hashing over whole batches of UTF-8 texts.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``, the contract's
``[^\\x20\\x09-\\x0D]+`` (UTF-8 continuation bytes never fall in that set).
Nothing here creates a Python object per word: a batch is one byte array, word
boundaries come from a lookup table and hashes from one prefix sum of
``table[byte] * B**k`` modulo 2**64 (B odd, hence invertible).
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NO_LETTER = np.ones(256, dtype=bool)
_NO_LETTER[128:] = _NO_LETTER[48:58] = _NO_LETTER[65:91] = _NO_LETTER[97:123] = False
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_WORD_BASE = _U(0xD1342543DE82EF95)
_WORD_INV = _U(pow(0xD1342543DE82EF95, -1, 2**64))

#: Texts are hashed in blocks of about this many bytes, which bounds memory.
BLOCK_BYTES = 1 << 18

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: np.uint64, inverse: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**k`` and ``base**-k`` for k < n, kept for the worker's next block."""
    kept = _powers.get(int(base))
    if kept is None or len(kept[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        up, down = np.full(size, base), np.full(size, inverse)
        up[0] = down[0] = 1
        kept = _powers[int(base)] = np.cumprod(up), np.cumprod(down)
    return kept[0][:n], kept[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Words:
    """The words of a block of texts, in order: hash, text number, byte span.

    fold lower-cases A-Z; letters takes runs of ASCII letters, digits and bytes over 127 instead.
    """

    def __init__(self, texts: list[bytes], fold: bool = False, letters: bool = False):
        data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        space = np.ones(len(data) + 2, dtype=np.int8)
        space[1:-1] = (_NO_LETTER if letters else _SPACE)[data]
        edge = np.diff(space)
        self.start = np.flatnonzero(edge == -1)
        self.stop = np.flatnonzero(edge == 1)
        up, down = _power(_BASE, _BASE_INV, len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((_FOLDED if fold else _TABLE)[data] * up[:-1], out=sums[1:])
        self.hash = mix((sums[self.stop] - sums[self.start]) * down[self.start] + (self.stop - self.start).astype(np.uint64))
        #: words of text i are first[i] : first[i + 1]
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        self.base = ends - sizes
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.data = data
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.hash)

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the word sequences start : stop (word numbers), mixed with their lengths."""
        up, down = _power(_WORD_BASE, _WORD_INV, len(self) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self) + 1, dtype=np.uint64)
            np.cumsum(self.hash * up[:-1], out=self._sums[1:])
        return mix((self._sums[stop] - self._sums[start]) * down[start] + (stop - start).astype(np.uint64) * _U(0x9FB21C651E98DF25))


def blocks(values: list[bytes | None], limit: int = BLOCK_BYTES):
    """Cuts a list of texts (null counts as empty) into (first, texts) blocks of about limit bytes."""
    begin, held, size = 0, [], 0
    for i, value in enumerate(values):
        value = value or b""
        if held and size + len(value) > limit:
            yield begin, held
            begin, held, size = i, [], 0
        held.append(value)
        size += len(value) + 1
    if held:
        yield begin, held
