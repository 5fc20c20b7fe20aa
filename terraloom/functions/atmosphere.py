"""Hourly weather formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KELVIN = 273.15
JOULES_PER_MJ = 1e6


def celsius(kelvin: Column) -> Column:
    return kelvin - F.lit(KELVIN)


def saturation_vapour_pressure(temp_c: Column) -> Column:
    """kPa, Tetens form of FAO-56."""
    return F.lit(0.6108) * F.exp((F.lit(17.27) * temp_c) / (temp_c + F.lit(237.3)))


def vapour_pressure_deficit(temp_c: Column, dew_c: Column) -> Column:
    """kPa, never negative; NULL when either temperature is NULL."""
    deficit = saturation_vapour_pressure(temp_c) - saturation_vapour_pressure(dew_c)
    # greatest() skips NULLs, which would turn an unknown deficit into 0.
    return F.when(deficit.isNotNull(), F.greatest(deficit, F.lit(0.0)))


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def megajoules(joules: Column) -> Column:
    return joules / F.lit(JOULES_PER_MJ)
