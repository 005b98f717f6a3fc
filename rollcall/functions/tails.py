"""Tail probabilities as column expressions (no SciPy needed).

``erfc`` uses the published rational Chebyshev fit whose relative error stays
below 1.2e-7, which is enough for p-values.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published erfc fit, constant term first.
ERFC_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + z * 0.5)
    poly = reduce(lambda acc, c: acc * t + F.lit(c), reversed(ERFC_FIT[:-1]), F.lit(ERFC_FIT[-1]))
    tail = t * F.exp(-z * z + poly)
    return F.when(x >= 0, tail).otherwise(F.lit(2.0) - tail)


def normal_cdf(x: Column) -> Column:
    return erfc(-x / math.sqrt(2.0)) / 2.0


def chi_square_upper(x: Column, df: int) -> Column:
    """P(X > x) for integer degrees of freedom, by the finite series."""
    half = x / 2.0
    if df % 2 == 0:
        terms = [F.pow(half, F.lit(float(i))) / math.factorial(i) for i in range(df // 2)]
        return F.exp(-half) * reduce(lambda a, b: a + b, terms)
    out = erfc(F.sqrt(half))
    for i in range(1, (df - 1) // 2 + 1):
        out = out + F.exp(-half) * F.pow(half, F.lit(i - 0.5)) / math.gamma(i + 0.5)
    return out


# Coefficients of Acklam's rational approximation of the normal
# quantile (relative error under 1.2e-9), from the highest power down.
QUANTILE_MID = ([-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
                 -3.066479806614716e+01, 2.506628277459239e+00],
                [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
                 -1.328068155288572e+01, 1.0])
QUANTILE_TAIL = ([-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
                  4.374664141464968e+00, 2.938163982698783e+00],
                 [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0])
QUANTILE_CUT = 0.02425


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal distribution for p strictly between 0 and 1."""
    def poly(coefs: list[float], x: Column) -> Column:
        out = F.lit(coefs[0])
        for c in coefs[1:]:
            out = out * x + F.lit(c)
        return out

    q = p - 0.5
    mid = poly(QUANTILE_MID[0], q * q) * q / poly(QUANTILE_MID[1], q * q)
    t = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    tail = poly(QUANTILE_TAIL[0], t) / poly(QUANTILE_TAIL[1], t)
    return F.when(p < QUANTILE_CUT, tail).when(p > 1.0 - QUANTILE_CUT, -tail).otherwise(mid)


def _log_gamma_rise(x: Column, d: Column) -> Column:
    """log gamma(x + d) - log gamma(x) for x of 20 or more; nothing large is subtracted, however large x is."""
    tail = lambda v: 1 / (12 * v) - 1 / (360 * v ** 3) + 1 / (1260 * v ** 5)
    return d * F.log(x) + (x + d - 0.5) * F.log1p(d / x) - d + tail(x + d) - tail(x)


def _digamma_rise(x: Column, d: Column) -> Column:
    tail = lambda v: -1 / (2 * v) - 1 / (12 * v ** 2) + 1 / (120 * v ** 4) - 1 / (252 * v ** 6) + 1 / (240 * v ** 8)
    return F.log1p(d / x) + tail(x + d) - tail(x)


def _trigamma_fall(x: Column, d: Column) -> Column:
    tail = lambda v: 1 / (2 * v ** 2) + 1 / (6 * v ** 3) - 1 / (30 * v ** 5) + 1 / (42 * v ** 7) - 1 / (30 * v ** 9)
    return d / (x * (x + d)) + tail(x) - tail(x + d)


#: Terms of ``rising`` that are added one by one; the rest has a closed form there.
_EXACT = 20


def rising(a: Column, n: Column) -> Column:
    """Struct of the sums over j = 0 .. n - 1 of log(a + j), 1 / (a + j) and 1 / (a + j)^2.

    The first terms are added; beyond them, where a + j is at least 20, the
    differences of gamma, digamma and trigamma are series of a few terms. So a
    count of any size costs the same.
    """
    def sums(v: Column) -> Column:
        a, n = v["a"], v["n"]
        low = F.slice(F.sequence(F.lit(0), F.lit(_EXACT - 1)), F.lit(1), F.least(n, F.lit(_EXACT)).cast("int"))
        added = lambda f: F.aggregate(low, F.lit(0.0), lambda s, j: s + f(a + j))
        rest = lambda f: F.when(n > _EXACT, f(a + _EXACT, n - _EXACT)).otherwise(0.0)
        return F.struct((added(F.log) + rest(_log_gamma_rise)).alias("s0"), (added(lambda x: 1 / x) + rest(_digamma_rise)).alias("s1"),
                        (added(lambda x: 1 / (x * x)) + rest(_trigamma_fall)).alias("s2"))

    # bound, so that the sums are made once however often they are used
    return F.transform(F.array(F.struct(a.cast("double").alias("a"), n.cast("double").alias("n"))), sums)[0]


def ratio_below_zero(weights: Column) -> Column:
    """Probability that a sum of squared standard normal numbers with these weights is below zero.

    The inversion integral of its characteristic function, over exp(pi / 2
    sinh(g)), where equal steps of g converge at once: what is left of the
    integrand neither oscillates nor has ends.
    """
    def term(k: Column) -> Column:
        g = k / 16.0
        u = F.exp(math.pi / 2 * F.sinh(g))
        angle = F.aggregate(weights, F.lit(0.0), lambda s, w: s + F.atan(w * u))
        size = F.aggregate(weights, F.lit(0.0), lambda s, w: s + F.log(1 + (w * u) * (w * u)))
        return math.pi / 32 * F.cosh(g) * F.sin(angle / 2) / F.exp(size / 4)

    total = F.aggregate(F.sequence(F.lit(-64), F.lit(64)), F.lit(0.0), lambda s, k: s + term(k))
    return F.greatest(F.least(0.5 - total / math.pi, F.lit(1.0)), F.lit(0.0))
