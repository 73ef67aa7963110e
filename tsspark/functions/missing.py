"""One missing value: NULL. NaN is turned into NULL where data enters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    fractional = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not fractional:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in fractional})


def is_finite(value: Column) -> Column:
    """True for a number that is neither missing, NaN nor infinite."""
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False)) & ~F.coalesce(F.isnan(value), F.lit(True))


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.NumericType, T.BooleanType))
