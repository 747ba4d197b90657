"""Bias-corrected shape statistics, as Columns and on collected sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

def is_constant(value: Column) -> Column:
    """Merged partial moments may leave a constant a tiny spread; this cannot."""
    return F.min(value) == F.max(value)


def sample_std(value: Column) -> Column:
    """Sample deviation: NULL below 2 values, exactly 0 for a constant."""
    spread = F.when(is_constant(value), 0.0).otherwise(F.stddev_samp(value))
    return F.when(F.count(value) > 1, spread)


def skewness_g1(value: Column) -> Column:
    """Adjusted Fisher-Pearson skewness: NULL below 3 values, 0 for a constant."""
    n = F.count(value).cast("double")
    corrected = F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.when(is_constant(value), 0.0).otherwise(corrected))


def kurtosis_g2(value: Column) -> Column:
    """Bias-corrected excess kurtosis: NULL below 4 values, 0 for a constant."""
    n = F.count(value).cast("double")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6)
    return F.when(n >= 4, F.when(is_constant(value), 0.0).otherwise(corrected))


def skewness_from_sums(n: float, squares: float, cubes: float) -> float | None:
    """The same skewness from sums of centred squares and cubes. The squares of a constant
    are exactly zero, see sample_std."""
    if n < 3:
        return None
    if squares == 0.0:
        return 0.0
    variance = squares / n
    return math.sqrt(n * (n - 1)) / (n - 2) * (cubes / n) / variance**1.5
