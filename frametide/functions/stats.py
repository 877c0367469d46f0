"""Tails of distributions that Spark lacks, for a handful of test statistics; the statistics themselves are made by Spark."""

from __future__ import annotations

import math


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            c = 1 + k / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def student_tail(t: float, df: float) -> float:
    """P(T > t)."""
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return half if t > 0 else 1 - half


def slope_p(r: float, n: int, alternative: str = "two-sided") -> float:
    """The p-value of a regression's slope from its correlation."""
    if n < 3 or r is None:
        return math.nan
    t = r * math.sqrt((n - 2) / max(1e-300, (1 - r) * (1 + r)))
    return {"two-sided": 2 * student_tail(abs(t), n - 2), "greater": student_tail(t, n - 2), "less": 1 - student_tail(t, n - 2)}[alternative]


def mann_whitney_p(u: float, n: int, m: int, ties: float = 0.0) -> float:
    """P(U >= u), one-sided. Exact for a small group without ties, else normal with continuity correction; ties: sum of t**3 - t."""
    if not n or not m:
        return math.nan
    if min(n, m) <= 8 and not ties:
        # How many ways give each U: a Gaussian binomial coefficient, one factor after another.
        ways = [1] + [0] * (n * m)
        for k in range(1, min(n, m) + 1):
            big = max(n, m) + k
            for s in range(n * m, big - 1, -1):
                ways[s] -= ways[s - big]
            for s in range(k, n * m + 1):
                ways[s] += ways[s - k]
        return sum(ways[math.ceil(u) :]) / math.comb(n + m, n)
    mean, total = n * m / 2, n + m
    sd = math.sqrt(n * m / 12 * ((total + 1) - ties / (total * (total - 1))))
    return normal_tail((u - mean - 0.5) / sd) if sd else math.nan
