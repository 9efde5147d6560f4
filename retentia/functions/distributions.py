"""Tail probabilities of the normal, chi-square, F and t distributions.

Used on the driver on one-row results (a test statistic and its degrees of
freedom), never per row; ``functions.tails`` has column versions.

Chi-square tails with whole degrees of freedom are finite sums of Poisson-like
terms. F and t tails are incomplete beta integrals. With u = x exp(-r / a),

    I_x(a, b) = x^a / (a B(a, b)) * integral over r > 0 of exp(-r) (1 - x exp(-r / a))^(b - 1),

an integral that is smooth but for r = 0, and that the double exponential
substitution r = exp(t - exp(-t)) turns into a trapezoid sum.
"""

from __future__ import annotations

import math

import numpy as np

_T = np.arange(-5.0, 5.5, 1 / 64)
_R = np.exp(_T - np.exp(-_T))
_W = _R * (1 + np.exp(-_T)) / 64 * np.exp(-_R)


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def _missing(x: float | None) -> bool:
    return x is None or math.isnan(x)


def chi2_sf(x: float, dof: int) -> float:
    """P(chi-square > x) for whole ``dof``: terms (x/2)^k / Gamma(k + 1) e^(-x/2), k below dof / 2 in steps of one."""
    if _missing(x):
        return float("nan")
    half = max(float(x), 0.0) / 2.0
    if half == 0.0:
        return 1.0
    odd = int(dof) % 2
    powers = np.arange(int(dof) // 2) + 0.5 * odd
    terms = [math.exp(k * math.log(half) - half - math.lgamma(k + 1.0)) for k in powers]
    return min(1.0, math.fsum(terms) + (math.erfc(math.sqrt(half)) if odd else 0.0))


def _log_rise(a: float, b: float) -> float:
    """log Gamma(a + b) - log Gamma(a), without cancellation for large a."""
    if a < 1e5:
        return math.lgamma(a + b) - math.lgamma(a)
    return b * math.log(a) + b * (b - 1) / (2 * a) - b * (b - 1) * (2 * b - 1) / (12 * a * a)


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    # 1 - x exp(-r/a), accurate for x near 1 and large a
    rest = (1.0 - x) - x * np.expm1(-_R / a)
    total = float((_W * rest ** (b - 1.0)).sum())
    return min(1.0, math.exp(a * math.log(x) - math.log(a) + _log_rise(a, b) - math.lgamma(b)) * total)


def f_sf(f: float, d1: float, d2: float) -> float:
    if _missing(f):
        return float("nan")
    return 1.0 if f <= 0 else betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_sf_two_sided(t: float, dof: float) -> float:
    if _missing(t):
        return float("nan")
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))
