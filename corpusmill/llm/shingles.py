"""Word shingle sets of UTF-8 texts: as 64-bit hashes, and as the words themselves."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Bytes of a word from which on it is hashed by itself.
LONG = 64
_CHAIN = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of an 8-byte chunk that belong to a word with so many left.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> list[np.ndarray]:
    """Powers of a rolling hash's base and of its inverse, n at least."""
    while len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            step = np.uint64(pow(b, len(_powers[k]), 1 << 64))
            _powers[k] = np.concatenate([_powers[k], _powers[k] * step])
    return _powers


def words(raw: np.ndarray, *seeds: int) -> list[np.ndarray]:
    """For each seed (by default 0), a hash of each word; A-Z count as a-z.

    A word goes in by chunks of eight bytes, each scrambled with all before
    it, so that no pattern of bytes cancels out; the few long ones are hashed
    by BLAKE2.
    """
    seeds = seeds or (0,)
    if not len(raw):
        return [np.zeros(0, dtype=np.uint64) for _ in seeds]
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    low = np.concatenate([np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw), np.zeros(8, np.uint8)])
    every = np.lib.stride_tricks.sliding_window_view(low, 8)
    sizes = ends - starts
    found = [mixed(sizes.astype(np.uint64) + (np.uint64(seed) << np.uint64(32))) for seed in seeds]
    on = np.flatnonzero(sizes < LONG)
    for k in range(0, LONG, 8):
        on = on[sizes[on] > k]
        if not len(on):
            break
        chunk = every[starts[on] + k].view(np.uint64)[:, 0] & _MASKS[np.minimum(sizes[on] - k, 8)]
        for h in found:
            h[on] = mixed((h[on] ^ chunk) * _CHAIN + np.uint64(k + 1))
    for i in np.flatnonzero(sizes >= LONG):
        for seed, h in zip(seeds, found, strict=True):
            h[i] = int.from_bytes(blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "big")).digest(), "big")
    return found


def _shingles(w: np.ndarray, n: int) -> np.ndarray:
    k = min(n, len(w))
    h = w[: len(w) - k + 1] if len(w) else w
    for i in range(1, k):
        h = mixed(h * _CHAIN + w[i : len(w) - k + 1 + i])
    return h


def shingle_set(raw: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-word shingles, sorted; with fewer words, all of them as one."""
    return np.unique(_shingles(words(raw)[0], n))


def classed(raw: np.ndarray, n: int) -> tuple[np.ndarray, bytes]:
    """The shingle set, and 128 bits that equal sets share: a digest of two hashes of every shingle."""
    one, two = words(raw, 0, 1)
    sets, at = np.unique(_shingles(one, n), return_index=True)
    return sets, blake2b(sets.tobytes() + _shingles(two, n)[at].tobytes(), digest_size=16).digest()


def word_shingles(raw: bytes, n: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, no hashes."""
    w = raw.lower().split()  # of bytes: ASCII letters and blanks only
    k = min(n, len(w))
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if w else set()
