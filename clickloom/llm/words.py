"""Words of many texts at once, as hashes, with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from clickloom.llm import arrow

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Digits, lower-case letters and every byte of a character beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True
# All but white space.
VISIBLE = np.ones(256, bool)
VISIBLE[9:14] = VISIBLE[32] = False

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


@dataclass
class Words:
    """Lower-cased bytes, first and end byte of each word, hash of each word, offsets of texts in words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    offsets: np.ndarray

    def text(self, first: int, n: int) -> bytes:
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(first, first + n))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0][0]) <= n:
        n = max(n, arrow.STEP_BYTES)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = [(both[0], both[1])]
    return _POWERS[0]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = LETTERS) -> Words:
    """Maximal runs of bytes of a kind, A-Z in lower case, never across texts."""
    data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[data]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[1:-1][cuts]
    last[cuts - 1] = inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    code = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Words(data, start, end, code, np.searchsorted(start, offsets))


def chain(code: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on."""
    out = code[at]
    for k in range(1, n):
        out = mix(out * np.uint64(0x100000001B3) + code[at + k])
    return out


def shingles(w: Words, n: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; of a shorter text, of its whole sequence; none without words."""
    many = len(w.start)
    full = chain(w.code, np.arange(max(many - n + 1, 0)), n)
    for a, z in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist()):
        if z - a >= n:
            yield np.unique(full[a : z - n + 1])
        elif z > a:
            yield chain(w.code, np.array([a]), z - a) ^ np.uint64(z - a)
        else:
            yield w.code[:0]
