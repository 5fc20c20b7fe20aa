"""Hourly reanalysis and daily rain, summarised per grid cell and composite period.

Everything is aggregated per weather cell first; stations that share a cell join the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions.atmosphere import (
    celsius,
    megajoules,
    vapour_pressure_deficit,
    wind_speed,
)
from terraloom.functions.calendar import number_days
from terraloom.functions.masks import flag, missing_count, or_zero
from terraloom.operators.periods import assign_period, period_days, rain_days
from terraloom.schemas import SAMPLING_METHOD, WEATHER_COLUMNS

CELL_PERIOD = ["cell_x", "cell_y", "period_start"]


def hourly_derived(hourly: DataFrame) -> DataFrame:
    air, dew = celsius(F.col("t2m")), celsius(F.col("d2m"))
    return hourly.select(
        "hour",
        "cell_x",
        "cell_y",
        air.alias("Tair_C"),
        dew.alias("Tdew_C"),
        vapour_pressure_deficit(air, dew).alias("VPD_kPa"),
        wind_speed(F.col("u10"), F.col("v10")).alias("Wind_ms"),
        megajoules(F.col("ssrd")).alias("SolarRad_MJ_m2_hour"),
    )


def period_weather(derived: DataFrame, periods: DataFrame) -> DataFrame:
    days = number_days(F.col("period_start"))
    sums = (
        assign_period(derived, "hour", periods)
        .groupBy(*CELL_PERIOD)
        .agg(
            F.avg("Tair_C").alias("Tair_mean_C"),
            F.max("Tair_C").alias("Tair_max_C"),
            F.avg("VPD_kPa").alias("VPD_mean_kPa"),
            F.max("VPD_kPa").alias("VPD_max_kPa"),
            F.sum("SolarRad_MJ_m2_hour").alias("__solar"),
            F.avg("Wind_ms").alias("Wind_mean_ms"),
        )
    )
    return sums.withColumn("SolarRad_MJ_m2_day", F.col("__solar") / days).select(
        *CELL_PERIOD, *WEATHER_COLUMNS[:6]
    )


def period_rain(rain: DataFrame, periods: DataFrame, lookback: int) -> DataFrame:
    """Rain of the period and of the `lookback` days before it, in one pass and one shuffle.

    The day list is broadcast: its length is calendar days, whatever the data size.
    """
    spread = rain.withColumnRenamed("day", "dd").join(
        F.broadcast(rain_days(periods, lookback)), "dd"
    )
    amount = F.col("precipitation")
    return spread.groupBy(*CELL_PERIOD).agg(
        F.sum(F.when(F.col("in_period"), amount)).alias("Precip_period_mm"),
        F.sum(F.when(~F.col("in_period"), amount)).alias("Precip_prev30d_mm"),
    )


def hour_counts(hourly: DataFrame, periods: DataFrame) -> DataFrame:
    """Distinct hours that the whole table holds per period, whatever the cells."""
    hours = hourly.select("hour").distinct()
    return (
        assign_period(hours, "hour", periods)
        .groupBy("period_start")
        .agg(F.count(F.lit(1)).cast("int").alias("era5_hours_total"))
    )


def rain_day_counts(rain: DataFrame, periods: DataFrame, lookback: int) -> DataFrame:
    """Distinct rain days that the whole table holds in each period and before it."""
    days = rain.select(F.col("day").alias("dd")).distinct()
    return (
        days.join(F.broadcast(rain_days(periods, lookback)), "dd")
        .groupBy("period_start")
        .agg(
            F.count_if(F.col("in_period")).cast("int").alias("chirps_days_period"),
            F.count_if(~F.col("in_period")).cast("int").alias("chirps_days_prev30"),
        )
    )


def period_counts(
    hourly: DataFrame, rain: DataFrame, periods: DataFrame, lookback: int
) -> DataFrame:
    """Actual and expected image counts of every period; one row per period."""
    start = F.col("period_start")
    return (
        periods.join(hour_counts(hourly, periods), "period_start", "left")
        .join(rain_day_counts(rain, periods, lookback), "period_start", "left")
        .select(
            "period_start",
            or_zero(F.col("era5_hours_total")).alias("era5_hours_total"),
            (number_days(start) * 24).alias("era5_hours_expected"),
            or_zero(F.col("chirps_days_period")).alias("chirps_days_period"),
            number_days(start).alias("chirps_days_expected"),
            or_zero(F.col("chirps_days_prev30")).alias("chirps_days_prev30"),
            F.lit(lookback).alias("chirps_days_prev30_expected"),
        )
    )


def with_completeness(frame: DataFrame) -> DataFrame:
    """Add the missing count and both completeness flags."""
    temporal = (
        (F.col("era5_hours_total") == F.col("era5_hours_expected"))
        & (F.col("chirps_days_period") == F.col("chirps_days_expected"))
        & (F.col("chirps_days_prev30") == F.col("chirps_days_prev30_expected"))
    )
    counted = frame.withColumns(
        {
            "meteo_missing_count": missing_count(WEATHER_COLUMNS),
            "meteo_temporal_complete": flag(temporal),
        }
    )
    complete = (F.col("meteo_missing_count") == 0) & (F.col("meteo_temporal_complete") == 1)
    return counted.withColumn("meteo_complete", flag(complete))


def attach_weather(
    observations: DataFrame,
    weather: DataFrame,
    rain: DataFrame,
    counts: DataFrame,
    era5_support_m: float,
    chirps_support_m: float,
) -> DataFrame:
    """Join the cell summaries to observations that carry `met_x/met_y` and `rain_x/rain_y`."""
    weather = weather.withColumnsRenamed({"cell_x": "met_x", "cell_y": "met_y"})
    rain = rain.withColumnsRenamed({"cell_x": "rain_x", "cell_y": "rain_y"})
    joined = (
        observations.join(weather, ["met_x", "met_y", "period_start"], "left")
        .join(rain, ["rain_x", "rain_y", "period_start"], "left")
        # One row per period: bounded by the calendar.
        .join(F.broadcast(counts), "period_start", "left")
        .withColumns(
            {
                "era5_support_m": F.lit(era5_support_m),
                "chirps_support_m": F.lit(chirps_support_m),
                "era5_sampling_method": F.lit(SAMPLING_METHOD),
            }
        )
    )
    return with_completeness(joined)
