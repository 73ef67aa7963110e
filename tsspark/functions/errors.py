"""Forecast error aggregates. MAPE takes the zero rule explicitly, since three are in use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Below these sizes an actual counts as zero.
NEAR_ZERO_EVALUATION = 1e-10
NEAR_ZERO_HISTORY = 1e-12


def mae(actual: Column, forecast: Column) -> Column:
    return F.avg(F.abs(actual - forecast))


def rmse(actual: Column, forecast: Column) -> Column:
    gap = actual - forecast
    return F.sqrt(F.avg(gap * gap))


def mape(actual: Column, forecast: Column, usable: Column | None = None) -> Column:
    """Percent; points whose actual is (nearly) zero are left out, NULL if none remains."""
    if usable is None:
        usable = F.abs(actual) > NEAR_ZERO_EVALUATION
    return F.avg(F.when(usable, F.abs((actual - forecast) / actual))) * 100


def absolute_percentage(actual: Column, forecast: Column) -> Column:
    """Ratio per point; a zero actual gives 0."""
    size = F.abs(actual)
    return F.when(size > NEAR_ZERO_HISTORY, F.abs(actual - forecast) / size).otherwise(F.lit(0.0))
