"""Statistics as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Variance under which skewness and kurtosis count as 0, by domain.
VARIANCE_FLOOR = {"time": 1e-10, "frequency": 1e-6, "time_frequency": 1e-6, "cepstral": 1e-10}


def stats4(y: Column, prefix: str, domain: str = "time") -> list[Column]:
    """mean, std (population), skewness and excess kurtosis (biased), the last two gated by variance."""
    gate = F.var_pop(y) >= VARIANCE_FLOOR[domain]
    return [
        F.avg(y).alias(f"{prefix}_mean"),
        F.stddev_pop(y).alias(f"{prefix}_std"),
        F.when(gate, F.skewness(y)).otherwise(0.0).alias(f"{prefix}_skew"),
        F.when(gate, F.kurtosis(y)).otherwise(0.0).alias(f"{prefix}_kurt"),
    ]


def corrected_skewness(y: Column) -> Column:
    """Bias-corrected; null for fewer than three values or none that differ."""
    n = F.count(y).cast("double")
    return F.when((n >= 3) & (F.var_pop(y) > 0), F.skewness(y) * F.sqrt(n * (n - 1)) / F.when(n >= 3, n - 2))


def corrected_kurtosis(y: Column) -> Column:
    """Bias-corrected excess; null for fewer than four values or none that differ."""
    n = F.count(y).cast("double")
    scale = (n - 1) / F.when(n >= 4, (n - 2) * (n - 3))
    return F.when((n >= 4) & (F.var_pop(y) > 0), scale * ((n + 1) * F.kurtosis(y) + 6))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
