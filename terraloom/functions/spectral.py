"""Reflectance scaling and normalised differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFLECTANCE_SCALE = 0.0001


def reflectance(dn: Column) -> Column:
    return dn * F.lit(REFLECTANCE_SCALE)


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); NULL for a NULL or negative input or a zero sum."""
    return F.when((a >= 0) & (b >= 0), F.try_divide(a - b, a + b))
