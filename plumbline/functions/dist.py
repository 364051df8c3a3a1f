"""Distribution functions the tests need, from their textbook formulae.

Everything here runs on a handful of numbers per group: moments and rank sums come from Spark.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
_TINY = 1e-300


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    # modified Lentz evaluation of the continued fraction
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    total = d
    for m in range(1, 10_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + numerator / c
            c = c if abs(c) > _TINY else _TINY
            step = c * d
            total *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * total


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    log_front = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - total * math.exp(log_front)
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    total = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        step = c * d
        total *= step
        if abs(step - 1.0) < 1e-15:
            break
    return total * math.exp(log_front)


def t_sf(t: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2.0, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1.0 - tail


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2.0, x / 2.0)


def _bisect(fn, lo: float, hi: float, rounds: int = 200) -> float:
    """Root of an increasing function."""
    for _ in range(rounds):
        mid = (lo + hi) / 2.0
        if mid in (lo, hi):
            break
        if fn(mid) < 0.0:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def t_isf(q: float, df: float) -> float:
    """t with upper tail ``q`` (q <= 0.5)."""
    hi = 2.0
    while t_sf(hi, df) > q:
        hi *= 2.0
    return _bisect(lambda t: q - t_sf(t, df), 0.0, hi)


def _nct_sf(crit: float, df: float, shift: float) -> float:
    """P(noncentral t > crit): the normal tail averaged over the chi density of the spread."""
    width = 14.0 / math.sqrt(2.0 * df)
    lo, hi = max(1e-12, 1.0 - width), 1.0 + width
    s = np.linspace(lo, hi, 4001)
    log_density = (math.log(2.0) + (df / 2.0) * math.log(df / 2.0) - math.lgamma(df / 2.0)
                   + (df - 1.0) * np.log(s) - df * s * s / 2.0)
    tail = np.array([norm_sf(v) for v in crit * s - shift])
    y = np.exp(log_density) * tail
    h = (hi - lo) / (len(s) - 1)
    return float(h / 3.0 * (y[0] + y[-1] + 4.0 * y[1:-1:2].sum() + 2.0 * y[2:-1:2].sum()))


def two_sample_power(d: float, n1: float, n2: float, alpha: float = 0.05) -> float:
    df = n1 + n2 - 2.0
    shift = d * math.sqrt(1.0 / (1.0 / n1 + 1.0 / n2))
    crit = t_isf(alpha / 2.0, df)
    return _nct_sf(crit, df, shift) + _nct_sf(crit, df, -shift)


def detectable_effect(n1: int, n2: int, alpha: float = 0.05, power: float = 0.8) -> float:
    """Smallest standardised difference these group sizes find with ``power``."""
    hi = 1.0
    while two_sample_power(hi, n1, n2, alpha) < power:
        hi *= 2.0
    return _bisect(lambda d: two_sample_power(d, n1, n2, alpha) - power, 0.0, hi, 60)


def rows_for_effect(d: float, alpha: float = 0.05, power: float = 0.8) -> float:
    """Rows per group, before rounding up."""
    hi = 4.0
    while two_sample_power(d, hi, hi, alpha) < power:
        hi *= 2.0
    return _bisect(lambda n: two_sample_power(d, n, n, alpha) - power, 2.0, hi, 60)
