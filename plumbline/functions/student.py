"""Student's t and Wilcoxon's signed ranks without SciPy, as plain functions and Arrow column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def t_ppf(p: float, df: float) -> float:
    """Quantile by bisection."""
    if p < 0.5:
        return -t_ppf(1 - p, df)
    lo, hi = 0.0, 1.0
    while t_sf(hi, df) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_sf(mid, df) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def signed_rank_tail(n: int, w: float, ties: float) -> float | None:
    """P(W >= w) for n non-zero differences: exact without ties up to 50 of them, else normal with tie correction (the sum of t³ - t), no continuity correction."""
    if not n:
        return None
    if not ties and n <= 50:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[: len(ways) - r]
        return float(ways[math.ceil(w) :].sum() / 2**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return 0.5 * math.erfc((w - n * (n + 1) / 4) / sd / math.sqrt(2)) if sd else 1.0


def wilcoxon_greater(x: list[float]) -> float | None:
    """One-sided p-value that the median is above zero, of a few values on the driver. Zeros are dropped."""
    x = np.array([v for v in x if v], float)
    if not len(x):
        return None
    _, at, n = np.unique(np.abs(x), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[at]
    return signed_rank_tail(len(x), float(ranks[x > 0].sum()), float((n**3 - n).sum()))


def wrong_target_limit(level: float = 0.95) -> float:
    """the coverage of an interval at `level` whose variance leaves out a second, equal part: 2 Φ(z / √2) - 1."""
    lo, hi = 0.0, 10.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid / math.sqrt(2)) < level else (lo, mid)
    return math.erf(lo / 2)


@F.pandas_udf(DoubleType())
def _quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    seen = {k: t_ppf(*k) for k in set(zip(p, df, strict=True)) if not any(map(pd.isna, k)) and k[1] > 0}
    return pd.Series([seen.get(k) for k in zip(p, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _survival(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else t_sf(a, b) for a, b in zip(t, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _tail(n: pd.Series, w: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else signed_rank_tail(int(a), b, c) for a, b, c in zip(n, w, ties, strict=True)], dtype=float)


def t_quantile(p: Column, df: Column) -> Column:
    return _quantile(p.cast("double"), df.cast("double"))


def t_survival(t: Column, df: Column) -> Column:
    return _survival(t, df.cast("double"))


def signed_rank_p(n: Column, w: Column, ties: Column) -> Column:
    """Of the number of non-zero differences, the rank sum of the positive ones, and the sum of t³ - t over ties."""
    return _tail(n.cast("double"), w.cast("double"), ties.cast("double"))
