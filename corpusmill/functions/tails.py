"""Closed-form tails of tests, on numbers that Spark has aggregated."""

from __future__ import annotations

import math

import numpy as np


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact binomial p of wins against losses, over 1,000 of them by the normal tail; 1 without any."""
    n = wins + losses
    if n == 0:
        return 1.0
    far = abs(wins - n / 2)
    if n > 1000:  # beyond exact binomials, with continuity correction
        return min(1.0, normal_two_sided(max(0.0, far - 0.5) / (math.sqrt(n) / 2)))
    return min(1.0, sum(math.comb(n, k) for k in range(n + 1) if abs(k - n / 2) >= far) / 2**n)


def wilson_lower(wins: int, n: int, z: float = 1.96) -> float:
    if n == 0:
        return 0.0
    p = wins / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def wilcoxon_p(n: int, w_plus: float, ties: float) -> float | None:
    """Two-sided p of the signed-rank sum; ties: sum of t^3 - t over tied groups. 1 without any difference, None under 5.

    Exact up to 50 differences of which no two are equal, else by the normal tail.
    """
    if n < 5:
        return None if n else 1.0
    if n <= 50 and ties == 0:  # exact: ways to reach each rank sum
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        least = int(min(w_plus, n * (n + 1) / 2 - w_plus))
        return float(min(1.0, 2 * ways[: least + 1].sum() / 2.0**n))
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return normal_two_sided((w_plus - n * (n + 1) / 4) / sd) if sd > 0 else 1.0


def ks_p(d: float, n: int, m: int) -> float:
    """Asymptotic two-sided p of a Kolmogorov-Smirnov distance."""
    if n < 2 or m < 2:
        return 1.0
    x = d * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))))


def frechet(mu1: np.ndarray, cov1: np.ndarray, mu2: np.ndarray, cov2: np.ndarray) -> float:
    """Distance of two Gaussians; the root's trace by eigenvalues of the product."""
    eig = np.linalg.eigvals(cov1 @ cov2)
    return float(((mu1 - mu2) ** 2).sum() + np.trace(cov1) + np.trace(cov2) - 2 * np.sqrt(np.clip(eig.real, 0, None)).sum())


def gaussian_kl(mu1: np.ndarray, cov1: np.ndarray, mu2: np.ndarray, cov2: np.ndarray) -> float:
    """Symmetric divergence of two Gaussians: the mean of the two directions, each counted twice over (without the factor of a half)."""
    i1, i2, d = np.linalg.pinv(cov1), np.linalg.pinv(cov2), mu1 - mu2
    return float(0.5 * (np.trace(i2 @ cov1) + np.trace(i1 @ cov2) - 2 * len(d) + d @ (i1 + i2) @ d))
