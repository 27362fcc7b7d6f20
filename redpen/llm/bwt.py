"""Common prefixes of suffixes by breadth-first backward extension on a Burrows-Wheeler transform.

After Beller, Gog, Ohlebusch and Schnattinger (2013): intervals of suffixes with a common prefix are
extended to the left by every letter before them, shortest prefixes first. The first interval that
ends at a place gives the length of the common prefix there, so lengths are found by increasing
value and the expansion can stop at the length that is asked for.
"""

from __future__ import annotations

import numpy as np

#: First levels, which are expanded over all ranks at once, and steps after which an interval counts as long.
_DENSE_LEVELS, _STEPS = 8, 12


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols or more (cyclic).

    Prefix doubling: suffixes in order of their second half are put in order of their first half by a stable
    sort of 16-bit digits. Ties beyond the depth keep any order.
    """
    n = len(symbols)
    used = np.bincount(symbols) > 0
    dense = (np.cumsum(used) - 1)[symbols]
    bits = max(1, int(used.sum() - 1).bit_length())
    width = 64 // bits
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = (key << np.uint64(bits)) | np.roll(dense, -k).astype(np.uint64)
    order = np.argsort(key)
    while True:
        ordered = key[order]
        new = np.empty(n, bool)
        new[0], new[1:] = False, ordered[1:] != ordered[:-1]
        ranks = np.cumsum(new)
        if width >= depth or ranks[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        order = (order - width) % n
        first = rank[order]
        by = np.argsort((first & 0xFFFF).astype(np.uint16), kind="stable")
        if n > 1 << 16:
            by = by[np.argsort((first[by] >> 16).astype(np.uint16), kind="stable")]
        order = order[by]
        key = rank * n + np.roll(rank, -width)
        width *= 2


def boundaries(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, flags): flag r is False exactly where suffixes r - 1 and r share `length` symbols or more."""
    n = len(symbols)
    order = suffix_order(symbols, length)
    before = symbols[order - 1]  # the transform; order 0 wraps around
    by_symbol = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)  # rank of the suffix that is one symbol longer, counted (ties beyond the depth have any order)
    to[by_symbol] = np.arange(n)
    following = np.full(n, n, np.int64)  # next rank with the same symbol in the transform
    same = before[by_symbol][1:] == before[by_symbol][:-1]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]

    marks = bytearray(n + 1)
    known = np.frombuffer(marks, bool)  # the same bytes, to be searched from the right as well
    first = symbols[order]
    known[0] = known[n] = True
    known[1:n] = first[1:] != first[:-1]
    fresh = np.flatnonzero(known)[1:]
    for level in range(length - 1):
        if not len(fresh):
            break
        found = _dense(fresh, known, following) if level < _DENSE_LEVELS else _stepwise(fresh, known, marks, following)
        target = to[found] + 1  # different for different ranks
        fresh = target[~known[target]]
        known[fresh] = True
    return order, known[:n]


def _dense(fresh: np.ndarray, known: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Last ranks of each symbol in the intervals that end at fresh places, over all ranks."""
    n = len(following)
    ends = np.flatnonzero(known)
    end = np.repeat(ends[1:], np.diff(ends))
    is_fresh = np.zeros(n + 1, bool)
    is_fresh[fresh] = True
    return np.flatnonzero((following >= end) & is_fresh[end])


def _stepwise(fresh: np.ndarray, known: np.ndarray, marks: bytearray, following: np.ndarray) -> np.ndarray:
    """The same by walking left from each fresh place; a longer interval's begin is looked up and all its ranks are taken."""
    out, rank, end = [], fresh - 1, fresh
    for _ in range(_STEPS):
        out.append(rank[following[rank] >= end])
        inside = ~known[rank]
        rank, end = rank[inside] - 1, end[inside]
        if not len(rank):
            return np.concatenate(out)
    begin = np.array([marks.rfind(1, 0, r + 1) for r in rank.tolist()], np.int64)
    size = rank - begin + 1
    every = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
    out.append(every[following[every] >= np.repeat(end, size)])
    return np.concatenate(out)


def repeated_starts(texts: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, flags of the starts whose `length` bytes also start elsewhere; a text of weight w stands w times."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    hi = np.cumsum(lens + 1) - 1
    raw[hi] = 0  # ends of texts are a symbol of their own
    lo = hi - lens
    order, cut = boundaries(raw, length)
    group = np.cumsum(cut) - 1
    doc = np.repeat(np.arange(len(texts)), lens + 1)
    inside = np.arange(len(raw)) + length <= hi[doc]
    total = np.bincount(group, weights=(weights[doc] * inside)[order], minlength=group[-1] + 1)
    flags = np.zeros(len(raw), bool)
    flags[order] = (total >= 2)[group]
    flags &= inside
    return [flags[a : max(a, b - length + 1)] for a, b in zip(lo, hi, strict=True)]
