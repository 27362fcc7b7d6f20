"""Content-defined runs of fixed-length byte windows.

Every window of LENGTH bytes has a minimizer: the k-gram in it of least hash, leftmost of equals.
Equal windows have equal minimizers at equal places, wherever they stand. Consecutive windows with
one minimizer are a run; a run's bytes are all that its windows cover.
"""

from __future__ import annotations

import numpy as np

from redpen.llm.textvec import U64, Prefix

_PLACE = U64((1 << 24) - 1)


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w consecutive ones, in linear time (van Herk, Gil and Werman)."""
    n = len(v)
    if n < w:
        return np.zeros(0, v.dtype)
    full = np.full(-(-n // w) * w, np.iinfo(v.dtype).max, v.dtype)
    full[:n] = v
    block = full.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


class Runs:
    """Runs of the windows of a list of texts: doc, first (place of its first window in the text), count (windows), at (the
    minimizer's place after the first window's), key (hash of the minimizer) and body (hash of all bytes of the run)."""

    def __init__(self, texts: list[bytes], length: int, k: int):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        if len(self.raw) >= 1 << 24:
            raise ValueError("texts of 16 MB or more have to be cut before")
        lo = np.cumsum(lens) - lens
        self.prefix = prefix = Prefix(self.raw)
        n = len(self.raw) - k + 1
        if n < length - k + 1:
            starts = np.zeros(0, np.int64)
            least = np.zeros(0, U64)
        else:
            at = np.arange(n)
            hashes = prefix.of(at, at + k)
            least = sliding_least((hashes & ~_PLACE) | at.astype(U64), length - k + 1)
            held = np.maximum(lens - length + 1, 0)
            valid = np.zeros(len(least) + 1, np.int64)
            good = np.flatnonzero(held)
            np.add.at(valid, lo[good], 1)
            np.add.at(valid, np.minimum(lo[good] + held[good], len(least)), -1)
            starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
        place = (least[starts] & _PLACE).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        doc = np.searchsorted(lo, starts, side="right") - 1
        new[1:] |= doc[1:] != doc[:-1]
        begin = np.flatnonzero(new)
        self.count = np.diff(np.append(begin, len(starts)))
        self.start = starts[begin]
        self.doc = doc[begin]
        self.first = self.start - lo[self.doc]
        self.at = place[begin] - self.start
        self.key = hashes[place[begin]] if len(begin) else np.zeros(0, U64)
        self.body = prefix.of(self.start, self.start + self.count + length - 1) if len(begin) else np.zeros(0, U64)
