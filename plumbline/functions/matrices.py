"""Small dense matrices as row-major arrays in column expressions; closed forms for two channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trace(a: Column, c: int) -> Column:
    return sum((a[i * c + i] for i in range(1, c)), a[0])


def shrink(a: Column, lam: float, c: int) -> Column:
    """(1 - lam) A + lam (tr A / c) I."""
    mu = trace(a, c) / c
    return F.transform(a, lambda x, k: (1 - lam) * x + F.when(F.pmod(k, F.lit(c + 1)) == 0, lam * mu).otherwise(0.0))


def frobenius2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def airm2(a: Column, b: Column) -> Column:
    """Squared affine-invariant distance of 2 x 2 SPD matrices: squared logs of the roots of z² - tr(A⁻¹B) z + det B / det A."""
    det = lambda m: m[0] * m[3] - m[1] * m[2]
    t = (a[3] * b[0] - a[1] * b[2] - a[2] * b[1] + a[0] * b[3]) / det(a)
    d = det(b) / det(a)
    root = F.sqrt(F.greatest(t * t / 4 - d, F.lit(0.0)))
    floor = F.lit(1e-12)
    return F.pow(F.ln(F.greatest(t / 2 + root, floor)), 2) + F.pow(F.ln(F.greatest(d / (t / 2 + root), floor)), 2)


def log2x2(a: Column) -> Column:
    """Matrix logarithm of a 2 x 2 SPD matrix: alpha I + beta A through its two eigenvalues."""
    t, gap = (a[0] + a[3]) / 2, F.sqrt(F.pow((a[0] - a[3]) / 2, 2) + a[1] * a[2])
    hi, lo = F.greatest(t + gap, F.lit(1e-12)), F.greatest(t - gap, F.lit(1e-12))
    beta = F.when(hi - lo > 1e-12, (F.ln(hi) - F.ln(lo)) / (hi - lo)).otherwise(1 / hi)
    alpha = F.ln(hi) - beta * hi
    return F.array(alpha + beta * a[0], beta * a[1], beta * a[2], alpha + beta * a[3])


def log_euclid2(a: Column, b: Column) -> Column:
    return frobenius2(log2x2(a), log2x2(b))


#: Distances by name, on row-major arrays of two channels. For more channels see functions.spd.
METRICS = {"airm": airm2, "logeuclid": log_euclid2, "euclid": frobenius2}
