"""Words of many texts at once, as numpy arrays over their concatenated UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Space and the characters 9 to 13, which separate words; words are `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers = {"of": np.ones(1, U64), "inverse": np.ones(1, U64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the hash base or of its inverse modulo 2^64."""
    if len(_powers[kind]) < n:
        x = np.full(max(n, 1 << 16), _BASE if kind == "of" else _INVERSE, U64)
        x[0] = 1
        _powers[kind] = np.multiply.accumulate(x)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Prefix:
    """Polynomial prefix hash of a byte buffer: 64-bit hashes of any of its slices."""

    def __init__(self, buf: np.ndarray):
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(_BYTE[buf] * _power("of", len(buf)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _power("inverse", len(self.sums))[start] + (end - start).astype(U64))


class Words:
    """Word bounds of a list of texts.

    buf: the texts, each followed by a space; lo, hi: bounds of each text; start, end: of each word;
    doc: the text of each word; first: index of the first word of each text; count: its number of words.
    """

    def __init__(self, texts: list[bytes]):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.hi = np.cumsum(lens + 1) - 1
        self.lo = self.hi - lens
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.is_word = ~SPACE[self.buf]
        edge = np.flatnonzero(np.diff(self.is_word.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.lo)
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def same_doc(self, n: int) -> np.ndarray:
        """Indices of words that begin a window of n words inside one text."""
        if len(self.doc) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])


def per_doc(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many of the flags lie in each [lo, hi)."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[hi] - sums[lo]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the key occurs more than once; the key occurred earlier."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    later[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later
