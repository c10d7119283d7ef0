"""Scoring expressions. Spark has no error function, so the normal distribution is a polynomial.

The polynomial is formula 26.2.17 of Abramowitz and Stegun (error below 7.5e-8), which SQL engines
can evaluate alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The coefficients of the formula, and its argument's scale.
PHI_SCALE = 0.2316419
PHI_COEFFICIENTS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def density(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_cdf(z: Column) -> Column:
    t = 1 / (1 + PHI_SCALE * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(PHI_COEFFICIENTS):
        poly = (poly + c) * t
    upper = density(z) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def normal_cdf_sql(z: str) -> str:
    """The same in SQL text."""
    t = f"(1 / (1 + {PHI_SCALE}::DOUBLE * abs({z})))"
    poly = "0.0::DOUBLE"
    for c in reversed(PHI_COEFFICIENTS):
        poly = f"(({poly} + ({c})::DOUBLE) * {t})"
    upper = f"(exp(-({z}) * ({z}) / 2) / {math.sqrt(2 * math.pi)!r}::DOUBLE * {poly})"
    return f"(CASE WHEN ({z}) >= 0 THEN 1 - {upper} ELSE {upper} END)"


def crps_gaussian(mean: Column, variance: Column, value: Column) -> Column:
    sigma = F.sqrt(variance)
    z = (value - mean) / sigma
    return sigma * (z * (2 * normal_cdf(z) - 1) + 2 * density(z) - 1 / math.sqrt(math.pi))


def pit(mean: Column, variance: Column, value: Column) -> Column:
    return normal_cdf((value - mean) / F.sqrt(variance))


def reduced_chi2(mean: Column, variance: Column, value: Column) -> Column:
    """Aggregate: mean of squared residuals over variances."""
    return F.avg(F.pow(value - mean, 2) / variance)


def coverage(mean: Column, variance: Column, value: Column, k: float = 1.0) -> Column:
    """Aggregate: share of values within k standard deviations, ends included."""
    return F.avg(F.when(F.abs(value - mean) <= k * F.sqrt(variance), 1.0).otherwise(0.0))


def skill(observed: Column, predicted: Column) -> Column:
    """Aggregate: max(0, 1 - rms(residual) / rms(observed)), 0 without signal."""
    signal = F.sqrt(F.avg(F.pow(observed, 2)))
    return F.when(signal == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.sqrt(F.avg(F.pow(observed - predicted, 2))) / signal))


def rmse(observed: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(observed - predicted, 2)))
