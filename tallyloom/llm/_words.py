"""Words of many texts at once as numpy arrays: bounds in the UTF-8 bytes and 64-bit hashes.

All word classes used here are sets of bytes: every byte of a character beyond ASCII is either
inside words or outside them, so bounds in bytes and in characters agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z only
_FOLDED = _BYTE[FOLD]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_COMBINE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: [^\x20\x09-\x0D]
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(n, base)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes, null as empty, and the offsets of its n texts (n + 1)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


class Words:
    """starts, ends: each word's bytes; hashes; first: index of each text's first word (n + 1)."""

    def __init__(self, column: pa.Array, inside: np.ndarray, fold: bool = True):
        self.buf, self.offsets = buf, offsets = text_bytes(column)
        w = inside[buf]
        before, after = np.zeros_like(w), np.zeros_like(w)
        before[1:], after[:-1] = w[:-1], w[1:]
        edges = offsets[(offsets > 0) & (offsets < len(buf))]
        before[edges], after[edges - 1] = False, False
        self.starts, self.ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        power, inverse = _power(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _BYTE)[buf] * power[:-1], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every k words in a row inside one text, and the index of each window's first word."""
        h = self.hashes
        if len(h) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        n = len(h) - k + 1
        x = np.zeros(n, np.uint64)
        for j in range(k):
            x += h[j : j + n] * _COMBINE[j]
        inside = np.ones(n, bool)
        for edge in self.first[1:-1]:
            inside[max(0, edge - k + 1) : min(edge, n)] = False
        at = np.flatnonzero(inside)
        return mix(x[at]), at

    def word(self, i: int) -> bytes:
        return FOLD[self.buf[self.starts[i] : self.ends[i]]].tobytes()


def sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct k-word shingles, sorted, one after the other, and where each text's begin (n + 1).

    A text of fewer than k words, but of one at least, has its whole sequence as its one shingle.
    """
    hashes, at = words.windows(k)
    owner = np.searchsorted(words.first, at, side="right") - 1
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.array([_sequence(words.hashes[words.first[d] : words.first[d + 1]]) for d in short], np.uint64)
        hashes, owner = np.concatenate([hashes, extra]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def _sequence(h: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([(h * _COMBINE[: len(h)]).sum() + np.uint64(len(h))], np.uint64))[0])
