"""Tail probabilities of the test distributions, for scalars on the driver.

Tails are computed directly, not as one minus the rest, so small ones keep their digits.
"""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()
_TINY = 1e-300


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    # continued fraction for the tail
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or _TINY)
            c = 1 + num / c or _TINY
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def _beta_tail(a: float, b: float, x: float, rest: float) -> float:
    """I_x(a, b) with ``rest`` = 1 - x given, so that neither end loses digits."""
    return beta_i(a, b, x) if x <= (a + 1) / (a + b + 2) else 1 - beta_i(b, a, rest)


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2) if x == x else math.nan


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    if t != t:
        return math.nan
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    half = 0.5 * _beta_tail(df / 2, 0.5, df / (df + t * t), t * t / (df + t * t))
    return half if t >= 0 else 1 - half


def f_sf(f: float, d1: float, d2: float) -> float:
    if f != f:
        return math.nan
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return _beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def kolmogorov_sf(d: float, n: int) -> float:
    """Two-sided Kolmogorov-Smirnov tail: the limiting series at Stephens' modified statistic."""
    root = math.sqrt(n)
    x = (root + 0.12 + 0.11 / root) * d
    if x < 0.27:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def two_sided(sf, statistic: float, *df: float) -> float:
    return min(1.0, 2 * sf(abs(statistic), *df))


def _poly(coefficients: tuple[float, ...], x: float) -> float:
    total = 0.0
    for c in reversed(coefficients):
        total = total * x + c
    return total


# The polynomial coefficients of Royston's algorithm AS R94, in ascending powers.
_W_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_W_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_SD = (-0.4803, -0.082676, 0.0030302)
_GAMMA = (-2.273, 0.459)


def shapiro_wilk(values) -> tuple[float, float]:
    """W and its p-value for 3 to 5000 values; (nan, nan) for fewer, (1, 1) for constant ones."""
    x = sorted(float(v) for v in values)
    n = len(x)
    if n < 3:
        return math.nan, math.nan
    if x[0] == x[-1]:
        return 1.0, 1.0
    m = [normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    total = math.fsum(v * v for v in m)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        u = 1 / math.sqrt(n)
        last = _poly(_W_LAST, u) + m[-1] / math.sqrt(total)
        if n > 5:
            second = _poly(_W_SECOND, u) + m[-2] / math.sqrt(total)
            phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = [-last, -second, *(v / math.sqrt(phi) for v in m[2:-2]), second, last]
        else:
            phi = (total - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [-last, *(v / math.sqrt(phi) for v in m[1:-1]), last]
    mean = math.fsum(x) / n
    w = math.fsum(c * v for c, v in zip(a, x, strict=True)) ** 2 / math.fsum((v - mean) ** 2 for v in x)
    w = min(w, 1.0)
    if n == 3:
        return w, min(1.0, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w >= 1:
        return 1.0, 1.0
    if n <= 11:
        bound = _poly(_GAMMA, n)
        y = math.log1p(-w)
        if y >= bound:
            return w, 1e-99
        z = (-math.log(bound - y) - _poly(_SMALL_MEAN, n)) / math.exp(_poly(_SMALL_SD, n))
    else:
        log_n = math.log(n)
        z = (math.log1p(-w) - _poly(_LARGE_MEAN, log_n)) / math.exp(_poly(_LARGE_SD, log_n))
    return w, normal_sf(z)


def mann_whitney_exact_sf(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties, by counting rank arrangements."""
    # counts of partitions of s into at most n1 parts of at most n2: Gaussian binomial coefficients
    table = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):
        up = n2 + i
        for s in range(n1 * n2, up - 1, -1):
            table[s] -= table[s - up]
        for s in range(i, n1 * n2 + 1):
            table[s] += table[s - i]
    total = sum(table)
    return sum(table[max(0, math.ceil(u)) :]) / total
