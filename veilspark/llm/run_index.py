"""A run-length index of a text: its Burrows-Wheeler transform by runs, with samples at the runs' ends.

Suffixes are sorted, and the character before each in that order is the transform. Where it equals the one before it, both
suffixes, each made a character longer, are neighbours again. So of all suffixes only the heads of runs are kept, each with
the suffix before it, which ends the run before, and how many characters they share. A walk through the text has all the
rest: one place further, the neighbour is one place further too and a character less is shared. In a repetitive text runs
are few.
"""

from __future__ import annotations

import numpy as np

_BITS, _PACKED = 9, 7  # characters below 2**9, seven of them in a key


def _keys(codes: np.ndarray) -> np.ndarray:
    """The first seven characters of each suffix as one number; beyond the end come zeros."""
    padded = np.append(codes.astype(np.int64), np.zeros(_PACKED, np.int64))
    out = np.zeros(len(codes), np.int64)
    for j in range(_PACKED):
        out <<= _BITS
        out |= padded[j : j + len(codes)]
    return out


def suffixes(codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes, by doubling; a round sorts only what is not settled yet."""
    n = len(codes)
    order = np.argsort(keys)
    new = np.append(True, keys[order][1:] != keys[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = _PACKED
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(slots):
        mine = order[slots]
        after = mine + depth
        pair = rank[mine] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(pair)
        mine, pair = mine[by], pair[by]
        new = np.append(True, pair[1:] != pair[:-1])
        order[slots] = mine
        rank[mine] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


def _shared(codes: np.ndarray, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many characters the suffixes at a and b share."""
    n, out = len(codes), np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    while len(open_):
        x, y = a[open_] + out[open_], b[open_] + out[open_]
        inside = (x < n) & (y < n)
        same = inside & (keys[np.minimum(x, n - 1)] == keys[np.minimum(y, n - 1)])
        last = open_[inside & ~same]
        for j in range(_PACKED - 1):
            x, y = a[last] + out[last], b[last] + out[last]
            last = last[(x < n) & (y < n)]
            last = last[codes[a[last] + out[last]] == codes[b[last] + out[last]]]
            out[last] += 1
        open_ = open_[same]
        out[open_] += _PACKED
    return out


class RunIndex:
    """codes: characters from 1 to 511."""

    def __init__(self, codes: np.ndarray):
        keys = _keys(codes)
        order = suffixes(codes, keys)
        before = np.where(order > 0, codes[order - 1], 0)
        heads = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        at, other = order[heads], order[np.maximum(heads - 1, 0)]
        del order
        #: The runs: a character each and how often it stands there.
        self.characters, self.lengths = before[heads], np.diff(np.append(heads, len(codes)))
        common = _shared(codes, keys, at[1:], other[1:])
        by = np.argsort(at)
        #: Of the suffixes that head runs, by place: the place, the end of the run before, and the characters they share.
        self.at, self.other, self.common = at[by], np.append(-1, other[1:])[by], np.append(0, common)[by]

    def matches(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the text with itself, at rising places: how long a match with the suffix next before it in order is, and where that stands."""
        sample = np.searchsorted(self.at, places, "right") - 1
        step = places - self.at[sample]
        return self.common[sample] - step, self.other[sample] + step

    def groups(self, places: np.ndarray, length: int, size: int) -> np.ndarray:
        """For each of `places` (rising) a name, the same for all that match over `length` characters at least; size: of the text."""
        found, other = self.matches(places)
        to = np.arange(size)
        linked = found >= length
        to[places[linked]] = other[linked]
        mine = to[places]
        while True:  # each round doubles the steps along a chain of neighbours
            next_ = to[mine]
            if np.array_equal(next_, mine):
                return mine
            to[places] = next_
            mine = next_
