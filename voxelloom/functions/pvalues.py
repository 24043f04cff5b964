"""Tail probabilities for the few rows of a test table (Arrow functions)."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta integral (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def _log_gamma_step(a: float, b: float) -> float:
    """log of gamma(a + b) / gamma(a).  The two logarithms cancel for large
    ``a``, where Stirling's series gives their difference without them."""
    if a < 1e4:
        return math.lgamma(a + b) - math.lgamma(a)
    return (a + b - 0.5) * math.log1p(b / a) + b * (math.log(a) - 1) + (1 / (a + b) - 1 / a) / 12


def regularised_beta(a: float, b: float, x: float, rest: float | None = None) -> float:
    """``rest`` is 1 - x, for an ``x`` so near to one that the difference has no digits left."""
    rest = 1 - x if rest is None else rest
    if x <= 0:
        return 0.0
    if rest <= 0:
        return 1.0
    log_x = math.log1p(-rest) if rest < 0.5 else math.log(x)
    front = math.exp(_log_gamma_step(a, b) - math.lgamma(b) + a * log_x + b * math.log(rest))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, rest) / b


def student_two_sided(t: float, df: float) -> float:
    if df > 1e5:  # the beta integral runs out of digits; Wallace's normal deviate is off by less than 1/df**2
        return normal_two_sided((8 * df + 1) / (8 * df + 3) * math.sqrt(df * math.log1p(t * t / df)))
    return regularised_beta(df / 2, 0.5, df / (df + t * t), t * t / (df + t * t))


# Fixed value: the exact law of the rank test is used if one sample is this small, whatever the size of the other.
EXACT_SMALL = 8


def rank_counts(small: int, large: int) -> np.ndarray:
    """Share of all orders of two tie-free samples by U (coefficients of the
    Gaussian binomial)."""
    ways = np.zeros(small * large + 1)
    ways[0] = 1.0
    for i in range(1, small + 1):
        shift = large + i
        if shift < len(ways):
            ways[shift:] -= ways[:-shift].copy()
        for start in range(i):  # division by 1 - q**i: running sums with step i
            ways[start::i] = np.cumsum(ways[start::i])
    return ways / ways.sum()


@cache
def _partition_numerator(parts: int) -> tuple[int, list[int]]:
    """``period, N`` such that N(q) / (1 - q**period)**(parts + 1) counts the
    partitions of at most k into parts of size 1 to ``parts``."""
    period, out = math.lcm(*range(1, parts + 1)), [1]
    for step in (1, *range(1, parts + 1)):  # times 1 + q**step + ... up to q**(period - step)
        wide = out + [0] * (period - step)
        for i in range(step, len(wide)):
            wide[i] += wide[i - step]
        for i in range(len(wide) - 1, period - 1, -1):
            wide[i] -= wide[i - period]
        out = wide
    return period, out


def rank_tail(lower: int, small: int, large: int) -> int:
    """Orders of two tie-free samples with U at most ``lower``, in whole
    numbers and without a table: the Gaussian binomial is the product of
    1 - q**(large + i) over that of 1 - q**i, and its 2**small terms above
    take their counts of partitions from a polynomial."""
    period, numerator = _partition_numerator(small)
    shifts = {0: 1}
    for i in range(1, small + 1):
        more = dict(shifts)
        for at, sign in shifts.items():
            if at + large + i <= lower:
                more[at + large + i] = more.get(at + large + i, 0) - sign
        shifts = more
    return sum(sign * numerator[r] * math.comb((lower - at - r) // period + small, small) for at, sign in shifts.items()
               for r in range((lower - at) % period, min(len(numerator) - 1, lower - at) + 1, period))


def rank_two_sided(u: float, n_a: int, n_b: int) -> float:
    """Exact two-sided p of U without ties."""
    small, large = sorted((int(n_a), int(n_b)))
    lower = small * large - int(max(u, n_a * n_b - u))
    return min(1.0, 2 * rank_tail(lower, small, large) / math.comb(small + large, small))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna()
    return pd.Series([student_two_sided(a, b) if k else None for a, b, k in zip(t, df, ok)], dtype="float64")


@pandas_udf(DoubleType())
def rank_p(u: pd.Series, n_a: pd.Series, n_b: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
    """Exact without ties where one sample is small, else the normal tail of ``z``."""
    out = []
    for v, a, b, t, s in zip(u, n_a, n_b, ties, z.astype(float)):
        if min(a, b) >= 1 and t == 0 and min(a, b) <= EXACT_SMALL:
            out.append(rank_two_sided(v, a, b))
        else:
            out.append(None if math.isnan(s) else normal_two_sided(s))
    return pd.Series(out, dtype="float64")


@pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(np.array([normal_two_sided(v) if not math.isnan(v) else math.nan for v in z.astype(float)]), dtype="float64")
