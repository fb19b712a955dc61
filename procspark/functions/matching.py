"""The Ratcliff-Obershelp ratio of many pairs of strings at once.

The ratio is twice the matched characters over all characters. Matched is the longest common block (of equal ones the first in the
left string, then in the right one) and, on either side of it, what this rule finds in the rests. For every left character one
number holds, as bits, the places of the right string with the same character. A block of ``k`` characters that ends at a left
character is a bit that, shifted, was a block of ``k - 1`` at the character before; so all blocks of all open rests grow together, one
shift and one ``and`` per length, and the last ones left are the longest.
"""

from __future__ import annotations

import difflib

import numpy as np

# Fixed value: from this length of the right string on, its frequent characters start no block.
FREQUENT_FROM = 200
WORD = 64
_PAIRS = 4096


def _equal_bits(left: list[str], right: list[str]) -> np.ndarray:
    """``[pair, left place]``: the right places with the same character, as bits of one word."""
    n, m = (np.array([len(t) for t in s], dtype=np.int64) for s in (left, right))

    def padded(texts: list[str], size: np.ndarray, width: int, fill: int) -> np.ndarray:
        wide = np.full((len(texts), width), fill, dtype=np.int32)
        wide[np.arange(width) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
        return wide

    a = padded(left, n, max(int(n.max()), 1), -1)
    b = padded(right, m, WORD, -2)
    out = np.empty(a.shape, dtype=np.uint64)
    for i in range(a.shape[1]):
        out[:, i] = np.packbits(b == a[:, i, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _below(k: np.ndarray) -> np.ndarray:
    """The lower ``k`` bits set."""
    k = k.astype(np.uint64)
    return np.where(k >= WORD, np.uint64(2 ** WORD - 1), (np.uint64(1) << np.minimum(k, np.uint64(WORD - 1))) - np.uint64(1))


def _longest(equal: np.ndarray, rests: np.ndarray) -> np.ndarray:
    """``start left, start right, length`` of the longest block of every rest ``pair, left from, to, right from, to``."""
    pair, a0, a1, b0, b1 = rests.T
    place = np.arange(equal.shape[1])
    open_ = equal[pair] & (_below(b1) & ~_below(b0))[:, None]
    open_[(place < a0[:, None]) | (place >= a1[:, None])] = 0
    found = np.zeros((len(rests), 3), dtype=np.int64)
    alive = np.flatnonzero(open_.any(axis=1))
    grown, same, length = open_[alive], open_[alive], 0
    while len(alive):
        length += 1
        # of the blocks of this length: the first end on the left, then the lowest bit
        i = (grown != 0).argmax(axis=1)
        word = grown[np.arange(len(alive)), i]
        j = np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        found[alive] = np.stack([i + 1 - length, j + 1 - length, np.full(len(alive), length)], axis=1)
        longer = np.zeros_like(grown)
        longer[:, 1:] = same[:, 1:] & (grown[:, :-1] << np.uint64(1))
        go = longer.any(axis=1)
        alive, grown, same = alive[go], longer[go], same[go]
    return found


def _ratios(left: list[str], right: list[str]) -> np.ndarray:
    equal = _equal_bits(left, right)
    n, m = (np.array([len(t) for t in s], dtype=np.int64) for s in (left, right))
    matched, zero = np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=np.int64)
    rests = np.stack([np.arange(len(left)), zero, n, zero, m], axis=1)
    while len(rests := rests[(rests[:, 1] < rests[:, 2]) & (rests[:, 3] < rests[:, 4])]):
        found = _longest(equal, rests)
        hit = found[:, 2] > 0
        rests, (i, j, k) = rests[hit], found[hit].T
        np.add.at(matched, rests[:, 0], k)
        before, after = rests.copy(), rests.copy()
        before[:, 2], before[:, 4] = i, j
        after[:, 1], after[:, 3] = i + k, j + k
        rests = np.concatenate([before, after])
    total = n + m
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """The ratio of every pair, ``left`` being the first sequence; not symmetric in general. Pairs whose right string does not fit a word of bits are
    few among names; they are compared one by one (and from ``FREQUENT_FROM`` characters on by that other rule for blocks)."""
    size = np.array([len(t) for t in right], dtype=np.int64)
    out = np.zeros(len(left))
    short = np.flatnonzero(size <= WORD)
    short = short[np.argsort([len(left[i]) for i in short], kind="stable")]  # like lengths in one table
    for at in range(0, len(short), _PAIRS):
        part = short[at:at + _PAIRS]
        out[part] = _ratios([left[i] for i in part], [right[i] for i in part])
    for i in np.flatnonzero(size > WORD):
        out[i] = difflib.SequenceMatcher(a=left[i], b=right[i]).ratio()
    return out
