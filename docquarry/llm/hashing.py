"""64-bit hashes of all tokens (words, lines, runs) in a buffer, as array work.

A token's hash is a polynomial in an odd base over random 64-bit values of its bytes, mixed at the end. With
prefix sums over the buffer, a token's polynomial is a difference times an inverse power. The values are
fixed, so equal bytes have equal hashes on every machine and in every run.
"""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes that are hashed at a time; a piece only ends where no token does, so it may be longer.
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(_BASE))


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(size, _BASE, U), np.full(size, inverse, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    turns = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        turns = np.concatenate([[0], turns])
    if len(mask) and mask[-1]:
        turns = np.concatenate([turns, [len(mask)]])
    return turns[::2], turns[1::2]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for spans of which the starts are sorted; they may overlap."""
    out = np.empty(len(starts), U)
    upto = np.maximum.accumulate(ends)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(upto, base + PIECE, side="right")))
        stop = int(upto[j - 1])
        size = stop - base
        up, down = _powers(1 << max(19, (size + 1).bit_length()))
        sums = np.empty(size + 1, U)
        sums[0] = 0
        np.cumsum(BYTE_VALUES[data[base:stop]] * up[:size], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U)
        i = j
    return mix(out)


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each position but the last n - 1."""
    if len(hashes) < n:
        return np.empty(0, U)
    m = len(hashes) - n + 1
    out = hashes[:m].copy()
    for k in range(1, n):
        out = mix(out * U(0xD6E8FEB86659FD93) + hashes[k : k + m])
    return out
