"""Closed-form statistics as column expressions: normal CDF and quantile, PSR/DSR, Wilson."""

from __future__ import annotations

import math
from functools import reduce
from math import e as E

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EULER_GAMMA

_TERMS = 120


def norm_cdf(x: Column) -> Column:
    """0.5 + phi(x)·(x + x³/3 + x⁵/15 + …); all terms share a sign, so the series loses no digits. |x| is held at 8."""
    z = F.greatest(F.least(x, F.lit(8.0)), F.lit(-8.0))
    sq = z * z
    series = F.aggregate(F.sequence(F.lit(_TERMS), F.lit(1)), F.lit(1.0), lambda acc, n: F.lit(1.0) + acc * sq / (2 * n + 1))
    return F.lit(0.5) + z * series * F.exp(-sq / 2) * F.lit(0.3989422804014327)


def norm_cdf_sql(x: str) -> str:
    """The same series in plain SQL, summed in place of nested text."""
    z = f"greatest(least({x}, 8.0::DOUBLE), -8.0::DOUBLE)"
    return (f"(0.5 + {z} * list_reduce(list_prepend(1.0::DOUBLE, range({_TERMS}, 0, -1)::DOUBLE[]), "
            f"lambda acc, n: 1.0 + acc * {z} * {z} / (2 * n + 1)) * exp(-{z} * {z} / 2) * 0.3989422804014327)")


# Rational approximation of the normal quantile (central and tail coefficients).
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)


def norm_ppf(p: Column) -> Column:
    """Rational start plus one Halley step against norm_cdf (about 1e-15)."""
    poly = lambda cs, v: reduce(lambda a, c: a * v + c, cs[1:], F.lit(cs[0]))
    q = p - 0.5
    r = q * q
    central = poly(_A, r) * q / (poly(_B, r) * r + 1)
    t_lo, t_hi = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    tail = lambda t: poly(_C, t) / (poly(_D, t) * t + 1)
    x = F.when(p < 0.02425, tail(t_lo)).when(p > 1 - 0.02425, -tail(t_hi)).otherwise(central)
    u = (norm_cdf(x) - p) * F.lit(2.5066282746310002) * F.exp(x * x / 2)
    return x - u / (1 + x * u / 2)


def psr(sr: Column, n: Column, skew: Column, kurt: Column, bench: Column) -> Column:
    """Probability that the true per-period Sharpe exceeds `bench`; kurt is raw kurtosis."""
    return norm_cdf((sr - bench) * F.sqrt(n - 1) / F.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr))


def expected_max_sharpe(n: Column, trials: int) -> Column:
    """Expected maximum per-period Sharpe of `trials` skill-free configurations."""
    z1, z2 = norm_ppf(F.lit(1 - 1 / trials)), norm_ppf(F.lit(1 - 1 / (trials * E)))
    return F.sqrt(F.lit(1.0) / n) * ((1 - EULER_GAMMA) * z1 + EULER_GAMMA * z2)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """R10."""
    p, den = k / n, 1 + z * z / n
    centre = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return centre - half, centre + half


def bonferroni(p: Column, tests: Column) -> Column:
    """R13."""
    return F.least(p * tests, F.lit(1.0))


# Coefficients of Stirling's series of the log-gamma function.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1, by Stirling's series at x + 10 and the recurrence back."""
    z = x.cast("double") + 10
    shift = F.lit(0.0)
    for i in range(10):
        shift = shift + F.log(x + i)
    tail = sum((F.lit(c) / F.pow(z, F.lit(2 * k + 1.0)) for k, c in enumerate(_STIRLING)), F.lit(0.0))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + tail - shift
