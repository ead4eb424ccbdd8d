"""Words of many texts at once, as numpy arrays over the texts' UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_M = (1 << 64) - 1


def _mixed(n: int) -> int:
    n = (n + 0x9E3779B97F4A7C15) & _M
    n = ((n ^ (n >> 30)) * 0xBF58476D1CE4E5B9) & _M
    n = ((n ^ (n >> 27)) * 0x94D049BB133111EB) & _M
    return n ^ (n >> 31)


#: One random 64-bit number a byte value, and odd bases (5 modulo 8, so that powers differ in their low bits).
_BYTES = np.array([_mixed(b + 1) for b in range(256)], np.uint64)
_BASES = [_mixed(1000 + k) & ~7 | 5 for k in range(4)]
_TERMS = np.array([_mixed(2000 + k) | 1 for k in range(64)], np.uint64)

#: ASCII letters in lower case; all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes inside words: all but white space; and digits, ASCII letters and everything beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), dtype=np.uint64, out=out[1:])
    return out


def _ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The polynomial of each range as if it began at 0."""
    inverse = _powers(pow(base, -1, 1 << 64), len(sums))
    return (sums[end] - sums[start]) * inverse[start]


@dataclass
class Words:
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after it
    hash: np.ndarray  #: 64 bits
    first: np.ndarray  #: of each text its first word; one more at the end

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def places(self, k: int) -> np.ndarray:
        """First words of all runs of k words inside one text."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        at = np.arange(len(self.start))
        return at[at + k <= last]


def bounds(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the maximal runs of `inside` bytes of each text, as in Words."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    w = inside[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    start = np.flatnonzero(w & (~before | cut[:-1]))
    return start, np.flatnonzero(w & (~after | cut[1:])) + 1, np.searchsorted(start, offsets)


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool) -> Words:
    """Maximal runs of `inside` bytes of each text."""
    start, end, first = bounds(raw, offsets, inside)
    if not len(start):
        return Words(start, end, start.astype(np.uint64), first)
    sums = _sums(_BYTES[LOWER[raw] if lower else raw], _BASES[0])
    return Words(start, end, mix(_ranges(sums, start, end, _BASES[0])), first)


def run_hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """64 bits for each run of k words that begins at one of `at`, by a sum with fixed random terms; for small k."""
    out = np.full(len(at), k * int(_TERMS[63]) & _M, np.uint64)
    for j in range(k):
        out += h[at + j] * _TERMS[j]
    return mix(out)


def long_run_hash(h: np.ndarray, at: np.ndarray, k: int, which: int) -> np.ndarray:
    """The same from prefix sums, for any k; `which` chooses one of three independent bases."""
    base = _BASES[1 + which]
    return mix(_ranges(_sums(h, base), at, at + k, base))
