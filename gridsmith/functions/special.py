"""Distribution functions for the correlation tests, in plain Python."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    """P(|N(0, 1)| >= |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_one(x: float) -> float:
    """P(chi-squared with one degree >= x)."""
    return math.erfc(math.sqrt(max(0.0, x) / 2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            k = 1.0
        elif i % 2 == 0:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + k * d or tiny)
        c = 1 + k / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))
