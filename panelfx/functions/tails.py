"""Tail areas and quantiles of the normal, t, F and chi-square laws for scalar test results."""

from __future__ import annotations

import math
from functools import lru_cache


def normal_p(z: float) -> float:
    """Two-sided p-value."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _betainc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(0, 2000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def t_p(t: float, df: float) -> float:
    """Two-sided p-value; an infinite df is the normal law."""
    if math.isinf(df) or df > 1e8:
        return normal_p(t)
    return _betainc(df / 2.0, 0.5, df / (df + t * t))


def f_p(f: float, df1: float, df2: float) -> float:
    """Upper tail."""
    if f <= 0:
        return 1.0
    if math.isinf(df2):
        return chi2_p(f * df1, df1)
    return _betainc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def chi2_p(x: float, k: float) -> float:
    """Upper tail by the series or the continued fraction of the incomplete gamma."""
    a, x = k / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    head = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * head
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return head * h


@lru_cache(maxsize=1024)
def t_quantile(p: float, df: float) -> float:
    """Inverse of the t law by bisection on the two-sided tail."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1.0 - p, df)
    target = 2.0 * (1.0 - p)
    lo, hi = 0.0, 2.0
    while t_p(hi, df) > target:
        hi *= 2.0
        if hi > 1e12:
            return math.inf
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if t_p(mid, df) > target else (lo, mid)
    return (lo + hi) / 2.0
