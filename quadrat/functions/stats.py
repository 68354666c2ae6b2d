"""Closed-form statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95, empty: tuple[float | None, float | None] = (0.0, 1.0)) -> tuple[Column, Column]:
    """Wilson interval of k successes in n; ``empty`` is what n = 0 gives."""
    p = F.try_divide(k.cast("double"), n.cast("double"))
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    den = 1 + z * z / n
    return F.when(n > 0, F.greatest(F.lit(0.0), (mid - half) / den)).otherwise(F.lit(empty[0]).cast("double")), F.when(n > 0, F.least(F.lit(1.0), (mid + half) / den)).otherwise(F.lit(empty[1]).cast("double"))


def shrunk(k: Column, n: Column, base: Column, strength: float) -> Column:
    return (k + strength * base) / (n + strength)


def entropy(counts: Column) -> Column:
    """Entropy in nats of an array of counts; 0 for nothing."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.aggregate(counts, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / total * F.ln(x / total)).otherwise(0.0)), F.lit(0.0))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts."""
    unit = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    both = F.zip_with(unit(p), unit(q), lambda a, b: F.struct(a.alias("a"), b.alias("b"), ((a + b) / 2).alias("m")))
    kl = lambda k: F.aggregate(both, F.lit(0.0), lambda s, x: s + F.when(x[k] > 0, x[k] * F.log2(x[k] / x["m"])).otherwise(0.0))
    return F.sqrt(F.greatest(F.lit(0.0), (kl("a") + kl("b")) / 2))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))).cast("double"), F.lit(0.0))


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a standard normal, by a rational approximation (absolute error below 1.5e-7): fixed coefficients."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    p = F.try_divide(k1 + k2, n1 + n2)
    return F.try_divide(F.try_divide(k1, n1) - F.try_divide(k2, n2), F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))))


def cohens_d(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    pooled = F.sqrt(F.try_divide((n_a - 1) * var_a + (n_b - 1) * var_b, n_a + n_b - 2))
    return F.try_divide(mean_a - mean_b, pooled)


def welch_t(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> tuple[Column, Column]:
    """(t, degrees of freedom)."""
    a, b = var_a / n_a, var_b / n_b
    return F.try_divide(mean_a - mean_b, F.sqrt(a + b)), F.try_divide(F.pow(a + b, 2), a * a / (n_a - 1) + b * b / (n_b - 1))
