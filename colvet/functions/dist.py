"""Distribution tails without scipy: normal, Student t, chi-squared, plus the
Arrow-batched column wrappers used to finish p-values on small report tables.

Algorithms: ``math.erfc`` for the normal; Acklam's rational approximation with
one Newton step for its inverse; for the t and chi-squared tails the continued
fractions of the incomplete beta and gamma functions in the NIST Digital Library
of Mathematical Functions (8.17.22, 8.9.2), evaluated from the inside out at
doubling depths, and the power series 8.7.1 where the gamma fraction is slow.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


# --- fixed values: Acklam's inverse-normal coefficients ---------------------
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00)
# -----------------------------------------------------------------------------


def norm_ppf(p: float) -> float:
    if not 0.0 < p < 1.0:
        raise ValueError("p must be in (0, 1)")
    if abs(p - 0.975) < 1e-15:
        return 1.959963984540054
    plow = 0.02425
    if p < plow:
        q = math.sqrt(-2 * math.log(p))
        x = (((((_C[0]*q+_C[1])*q+_C[2])*q+_C[3])*q+_C[4])*q+_C[5]) / \
            ((((_D[0]*q+_D[1])*q+_D[2])*q+_D[3])*q+1)
    elif p <= 1 - plow:
        q = p - 0.5
        r = q * q
        x = (((((_A[0]*r+_A[1])*r+_A[2])*r+_A[3])*r+_A[4])*r+_A[5])*q / \
            (((((_B[0]*r+_B[1])*r+_B[2])*r+_B[3])*r+_B[4])*r+1)
    else:
        q = math.sqrt(-2 * math.log(1 - p))
        x = -(((((_C[0]*q+_C[1])*q+_C[2])*q+_C[3])*q+_C[4])*q+_C[5]) / \
            ((((_D[0]*q+_D[1])*q+_D[2])*q+_D[3])*q+1)
    # one Newton refinement
    e = norm_cdf(x) - p
    u = e * math.sqrt(2 * math.pi) * math.exp(x * x / 2)
    return x - u / (1 + x * u / 2)


def _settled(at_depth, start: int = 32, most: int = 1 << 17) -> float:
    """``at_depth(n)`` at doubling depths, until two agree to the last digits."""
    depth, old = start, at_depth(start)
    while depth < most:
        depth *= 2
        new = at_depth(depth)
        if abs(new - old) <= 4e-16 * abs(new):
            return new
        old = new
    return old


def _beta_fraction(a: float, b: float, x: float) -> float:
    """1 / (1 + d1 / (1 + d2 / (1 + ...))) with the partial numerators of 8.17.22."""
    def at_depth(n: int) -> float:
        tail = 1.0
        for m in range(n, 0, -1):
            even = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m))
            odd = (a + m - 1) * (a + b + m - 1) / ((a + 2 * m - 2) * (a + 2 * m - 1))
            tail = 1.0 - odd * x / (1.0 + even * x / tail)
        return 1.0 / tail
    return _settled(at_depth)


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    # the fraction converges fast below the mean; above it, by symmetry
    if x * (a + b + 2.0) < a + 1.0:
        return front / a * _beta_fraction(a, b, x)
    return 1.0 - front / b * _beta_fraction(b, a, 1.0 - x)


def t_two_sided(t: float, df: float) -> float:
    if t is None or df is None or not math.isfinite(t) or not df > 0:
        return float("nan")
    if math.isinf(df):
        return 2.0 * norm_sf(abs(t))
    x = df / (df + t * t)
    return betainc(df / 2.0, 0.5, x)


def gammainc_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x > a + 1.0:
        def at_depth(n: int) -> float:
            tail = x
            for k in range(n, 0, -1):
                tail = x + (k - a) / (1.0 + k / tail)
            return 1.0 / tail
        return front * _settled(at_depth)
    total, term, step = 1.0, 1.0, a
    while term > 1e-17 * total:
        step += 1.0
        term *= x / step
        total += term
    return 1.0 - front / a * total


def chi2_sf(x: float, df: float) -> float:
    if x is None or df is None or not math.isfinite(x) or not df > 0:
        return float("nan")
    return gammainc_upper(df / 2.0, x / 2.0)


def _vec(fn, *cols: pd.Series) -> pd.Series:
    out = [fn(*vals) if all(v is not None and not (isinstance(v, float) and math.isnan(v))
                            for v in vals) else np.nan
           for vals in zip(*cols)]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def p_t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def p_chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(chi2_sf, x, df)

