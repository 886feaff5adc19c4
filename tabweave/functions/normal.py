"""Normal and Student distributions as column expressions, and the normal one on arrays (no Python per row)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 26.2.17, |error| < 7.5e-8.
_CDF_P = 0.2316419
_CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

# Acklam's rational approximation of the normal quantile,
# relative error < 1.15e-9.
_PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
          1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
          6.680131188771972e01, -1.328068155288572e01)
_PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
          -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
          3.754408661907416e00)
_PPF_LOW = 0.02425


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2.0) / F.lit(math.sqrt(2.0 * math.pi))


def normal_cdf(z: Column) -> Column:
    """P(Z <= z)."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(_CDF_P) * a)
    tail = normal_pdf(a) * t * _horner(t, tuple(reversed(_CDF_B)))
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)


def tail_scale(p: Column) -> Column:
    """The ``sqrt(-2 ln)`` term of the quantile's tails."""
    return F.sqrt(F.lit(-2.0) * F.log(F.least(p, F.lit(1.0) - p)))


def normal_ppf(p: Column, scale: Column | None = None) -> Column:
    """The normal quantile of ``p`` in (0, 1).

    ``scale`` is ``tail_scale(p)`` where it is a column already, so that it is
    computed once and not at each of its ten uses.
    """
    q = p - 0.5
    r = q * q
    centre = _horner(r, _PPF_A) * q / (_horner(r, _PPF_B) * r + 1.0)
    s = tail_scale(p) if scale is None else scale
    tail = _horner(s, _PPF_C) / (_horner(s, _PPF_D) * s + 1.0)
    return (
        F.when(p.between(_PPF_LOW, 1 - _PPF_LOW), centre)
        .when(p < 0.5, tail)
        .otherwise(-tail)
    )


def _horner_array(x: np.ndarray, coefficients: tuple[float, ...]) -> np.ndarray:
    total = np.full_like(x, coefficients[0])
    for c in coefficients[1:]:
        total = total * x + c
    return total


def normal_cdf_array(z: np.ndarray) -> np.ndarray:
    """``normal_cdf`` of an array."""
    a = np.abs(z)
    t = 1.0 / (1.0 + _CDF_P * a)
    tail = np.exp(-a * a / 2.0) / math.sqrt(2.0 * math.pi) * t * _horner_array(t, tuple(reversed(_CDF_B)))
    return np.where(z >= 0, 1.0 - tail, tail)


def normal_ppf_array(p: np.ndarray) -> np.ndarray:
    """``normal_ppf`` of an array."""
    q = p - 0.5
    r = q * q
    out = _horner_array(r, _PPF_A) * q / (_horner_array(r, _PPF_B) * r + 1.0)
    far = (p < _PPF_LOW) | (p > 1 - _PPF_LOW)
    s = np.sqrt(-2.0 * np.log(np.minimum(p[far], 1.0 - p[far])))
    tail = _horner_array(s, _PPF_C) / (_horner_array(s, _PPF_D) * s + 1.0)
    out[far] = np.where(p[far] < 0.5, tail, -tail)
    return out


_STEPS = 1500  # of Simpson's rule, times two
_REACH = 11.0  # beyond this, exp(-w * w / 2) is below 1e-26 of its start
_SHIFT = 64


def _gamma_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a), by the recurrence up to ``_SHIFT`` more and the asymptotic series there."""
    z = a + float(_SHIFT)
    r = F.lit(1.0) / z
    series = F.sqrt(z) * _horner(r, (-21 / 32768, 5 / 1024, 1 / 128, -1 / 8, 1.0))
    down = F.aggregate(F.sequence(F.lit(0), F.lit(_SHIFT - 1)), F.lit(1.0), lambda acc, j: acc * (a + j) / (a + j + 0.5))
    return series * down


def student_upper(t: Column, df: Column) -> Column:
    """P(T > t) for Student's t, for any positive number of degrees of freedom.

    The tail integral of the density, with w * w = df * ln(1 + u * u / df) in
    place of u: what is left is exp(-w * w / 2) times a smooth factor, whatever
    df is, so one rule of a fixed number of steps serves all.
    """
    nu = df.cast("double")
    low = F.sqrt(nu * F.log1p(t * t / nu))
    step = F.lit(_REACH / (2 * _STEPS))

    def value(w: Column) -> Column:
        smooth = F.when(w > 0, w / F.sqrt(nu * -F.expm1(-w * w / nu))).otherwise(1.0)
        return F.exp((low - w) * (low + w) / 2.0) * smooth

    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(2 * _STEPS)), F.lit(0.0),
        lambda acc, j: acc + value(low + j * step) * F.when(j.isin(0, 2 * _STEPS), 1.0).when(j % 2 == 1, 4.0).otherwise(2.0))
    tail = _gamma_ratio(nu / 2.0) / F.sqrt(nu * math.pi) * F.exp(-low * low / 2.0) * total * step / 3.0
    return F.when(t >= 0, tail).otherwise(1.0 - tail)
