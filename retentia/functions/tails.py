"""Tail probabilities as column expressions, for p-values inside a query."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _series(first: Column, terms: Column, ratio) -> Column:
    """first * (1 + r_1 + r_1 r_2 + ...) with ``terms`` factors r_i = ratio(i)."""
    start = F.struct(first.alias("term"), first.alias("sum"))

    def step(a, i):
        term = a["term"] * ratio(i.cast("double"))
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))
    return F.when(terms < 1, first).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, step, lambda a: a["sum"]))


def erfc(z: Column) -> Column:
    """1 - erf(z) for z >= 0: the power series of erf with positive terms, the leading asymptotic term beyond 6."""
    erf = _series(2 / math.sqrt(math.pi) * z * F.exp(-z * z), F.lit(160), lambda n: 2 * z * z / (2 * n + 1))
    return F.when(z > 6, F.exp(-z * z) / (z * math.sqrt(math.pi))).otherwise(F.greatest(1 - erf, F.lit(0.0)))


def chi2_tail(x: Column, dof: Column) -> Column:
    """P(chi-square with ``dof`` degrees of freedom > x): finite sums, plus erfc for odd ``dof``."""
    half = x / 2
    even = _series(F.exp(-half), (dof / 2).cast("int") - 1, lambda i: half / i)
    more = ((dof - 1) / 2).cast("int")
    odd = erfc(F.sqrt(half)) + F.when(more >= 1, _series(
        F.exp(-half) * F.sqrt(half) * 2 / math.sqrt(math.pi), more - 1, lambda i: half / (i + 0.5))).otherwise(0.0)
    return F.when(x.isNull(), None).when(dof % 2 == 0, even).otherwise(odd)


def log_gamma(z: Column) -> Column:
    """log Gamma(z) for z > 0: Stirling's series at z + 10, stepped back."""
    w = z + 10
    series = 1 / (12 * w) - 1 / (360 * F.pow(w, 3)) + 1 / (1260 * F.pow(w, 5)) - 1 / (1680 * F.pow(w, 7))
    back = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda a, i: a + F.log(z + i))
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + series - back


# Steps of the continued fraction; it needs about the square root of the larger parameter.
FRACTION_STEPS = 2000


def beta_tail(x: Column, rest: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta I_x(a, b) by its continued fraction, with ``rest`` = 1 - x given so that it keeps its digits.

    The fraction converges fast below the mean; above it the complement is taken."""
    def fraction(x, a, b):  # evaluated forwards: (numerator, denominator) ratios kept away from zero
        tiny = 1e-300

        def guard(v):
            return F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

        def step(s, i):
            m = F.floor(i / 2).cast("double")
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d = F.when(i % 2 == 0, even).otherwise(odd)
            den, num = 1 / guard(1 + d * s["den"]), guard(1 + d / s["num"])
            moved = F.struct(num.alias("num"), den.alias("den"), (s["value"] * num * den).alias("value"), (F.abs(num * den - 1) < 1e-16).alias("done"))
            return F.when(s["done"], s).otherwise(moved)
        start = F.struct(F.lit(1.0).alias("num"), F.lit(0.0).alias("den"), F.lit(1.0).alias("value"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), start, step, lambda s: 1 / s["value"])

    def lower(x, rest, a, b):
        front = F.exp(a * F.log(x) + b * F.log(rest) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a
        return front * fraction(x, a, b)
    inner = F.when(x < (a + 1) / (a + b + 2), lower(x, rest, a, b)).otherwise(1 - lower(rest, x, b, a))
    return F.when(x <= 0, F.lit(0.0)).when(rest <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), inner)))


def f_tail(f: Column, dof1: Column, dof2: Column) -> Column:
    """P(F > f) for any positive degrees of freedom; null where there are none."""
    d1, d2 = dof1.cast("double"), dof2.cast("double")
    below = d2 + d1 * f
    return F.when(f.isNotNull() & (d1 > 0) & (d2 > 0),
                  F.when(f <= 0, F.lit(1.0)).otherwise(beta_tail(d2 / below, d1 * f / below, d2 / 2, d1 / 2)))


def t_tail_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| > |t|) for any positive degrees of freedom."""
    d = dof.cast("double")
    below = d + t * t
    return F.when(t.isNotNull() & (d > 0), beta_tail(d / below, t * t / below, d / 2, F.lit(0.5)))
