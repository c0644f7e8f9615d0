"""Merging front-coded sorted runs by a loser tree that knows common prefixes."""

from __future__ import annotations

import numpy as np


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Sorted rows of equal width as (prefix lengths shared with the row before, tails)."""
    n, width = rows.shape
    shared = np.zeros(n, dtype=np.uint8)
    if n > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return shared, rows[np.arange(width) >= shared[:, None]].tobytes()


def merge(runs: list[tuple[list[int], bytes]], width: int) -> tuple[list[int], list[int], list[bytes]]:
    """(run, shared prefix, row) of all rows in order; equal rows of runs are all kept.

    Each contender carries the length of the prefix it shares with the last
    row given out. Of two, the one that shares more is smaller, without a look
    at their bytes; only if both share the same are bytes compared, from there
    on, and the loser keeps the length it shares with the winner. A run's next
    row shares with the last row given out what its front code says.
    """
    k = len(runs)
    lengths = [r[0] for r in runs]
    tails = [r[1] for r in runs]
    at, place = [0] * k, [0] * k  # next row, where its tail starts
    now: list[bytes] = [b""] * k
    shared = [-1] * k  # -1: the run is at its end

    def advance(r: int) -> None:
        i = at[r]
        if i == len(lengths[r]):
            shared[r] = -1
            return
        common = lengths[r][i]
        start = place[r]
        place[r] = end = start + width - common
        now[r] = now[r][:common] + tails[r][start:end]
        shared[r] = common
        at[r] = i + 1

    for r in range(k):
        advance(r)
    losers = [0] * max(1, k)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        la, lb = shared[a], shared[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        if la < 0:
            return a, b
        x, y, d = now[a], now[b], la
        while d < width and x[d : d + 8] == y[d : d + 8]:
            d += 8
        while d < width and x[d] == y[d]:
            d += 1
        if d >= width or x[d] < y[d]:
            shared[b] = min(d, width)
            return a, b
        shared[a] = d
        return b, a

    top = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        top[node], losers[node] = play(top[2 * node], top[2 * node + 1])
    best = top[1] if k > 1 else 0
    out_run: list[int] = []
    out_shared: list[int] = []
    out_row: list[bytes] = []
    while k and shared[best] >= 0:
        out_run.append(best)
        out_shared.append(shared[best])
        out_row.append(now[best])
        advance(best)
        node = (best + k) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1
    return out_run, out_shared, out_row
