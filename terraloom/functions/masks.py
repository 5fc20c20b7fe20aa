"""NULL and NaN handling. A masked pixel is a NULL band value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_as_null(frame: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, so that it counts as masked."""
    columns = [
        F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in frame.schema.fields
    ]
    return frame.select(*columns)


def all_present(columns: list[str]) -> Column:
    """Joint mask: valid only when every band is valid."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def flag(condition: Column) -> Column:
    """0/1 with NULL read as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def or_zero(column: Column, zero: float | int = 0) -> Column:
    return F.coalesce(column, F.lit(zero))


def is_missing(column: str) -> str:
    """NULL or NaN: what is counted as missing is also what gets filled."""
    return f"(`{column}` is null or isnan(`{column}`))"


def missing_count(columns: list[str]) -> Column:
    return F.expr(" + ".join(f"cast({is_missing(c)} as int)" for c in columns))


def missing_names(columns: list[str]) -> Column:
    """Names of the missing columns, in the given order."""
    names = ", ".join(f"if({is_missing(c)}, '{c}', null)" for c in columns)
    return F.expr(f"array_compact(array({names}))")
