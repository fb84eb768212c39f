"""Vectorised text primitives over a slice of texts laid end to end: rolling hashes, words, lines.

The hash of a span is a polynomial over random byte codes modulo 2**64 with an odd base, so prefix sums and the inverse
powers of the base give every span's hash at once; a finaliser spreads it. All workers use the same constants."""

from __future__ import annotations

import numpy as np

_M = 1 << 64
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CODES2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 20), base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.cumprod(out)
        if n > 1 << 22:  # of one very long text; not kept
            _powers.pop(base)
    return have[:n]


def inverse(base: int = _BASE) -> int:
    return pow(base, -1, _M)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix(buf: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """Prefix sums of the polynomial; the last entry covers the whole slice."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(codes[buf] * powers(_BASE, len(buf)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((sums[ends] - sums[starts]) * powers(inverse(), len(sums))[starts])


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text) of the words of each text; words never cross texts."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~IS_SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text) of the lines of each text; an empty text has one empty line."""
    cut = np.flatnonzero(buf == 10)
    text = np.searchsorted(offs, cut, "right") - 1
    starts = np.concatenate([offs[:-1], cut + 1])
    owner = np.concatenate([np.arange(len(offs) - 1), text])
    ends = np.concatenate([offs[1:], cut])
    order, to = np.lexsort((starts, owner)), np.lexsort((ends, owner))
    return starts[order], ends[to], owner[order]


def segments_sum(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def distinct(h: np.ndarray) -> np.ndarray:
    """The different values in order, by a sort: many times faster on integers than a hash table."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
