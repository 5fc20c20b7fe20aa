"""Valid observations -> weather, statistics over both supports, output rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.config import AnalysisConfig
from terraloom.functions.calendar import quarter_label
from terraloom.operators.bounds import bounds_of
from terraloom.operators.observations import (
    output_columns,
    unfold_scales,
    with_missing_statistics,
    with_row_status,
)
from terraloom.operators.optical import daily_stack, dealt_pixels, medoid, optical_predictors
from terraloom.operators.radar import dealt_passes, radar_medians
from terraloom.operators.storage import written
from terraloom.operators.worklist import PARTITION
from terraloom.operators.weather import (
    attach_weather,
    hourly_derived,
    period_counts,
    period_rain,
    period_weather,
)
from terraloom.operators.zonal import PATCH, Source, statistics_of, with_patch
from terraloom.plans.availability import (
    availability,
    clear_rows,
    periods_of,
    radar_rows,
    valid_observations,
)
from terraloom.plans.inputs import Inputs, Places
from terraloom.plans.restriction import of_quarters, of_stations, window_of
from terraloom.schemas import OPTICAL_BANDS, OPTICAL_PREDICTORS, RADAR_PREDICTORS
from terraloom.sources.scans import scan_hourly, scan_rain


@dataclass(frozen=True)
class TrainingTables:
    """`all` has both rows of every valid observation; the rest are its complete rows."""

    all: DataFrame

    @property
    def final(self) -> DataFrame:
        return self.all.filter(F.col("stats_complete") == 1)

    @property
    def footprint(self) -> DataFrame:
        return self.final.filter(F.col("scale") == "footprint")

    @property
    def local(self) -> DataFrame:
        return self.final.filter(F.col("scale") == "local_60m")


def meteorology(
    observations: DataFrame,
    inputs: Inputs,
    places: Places,
    config: AnalysisConfig,
    periods: DataFrame,
) -> DataFrame:
    """Add all weather columns to observations keyed by site and `period_start` (DATE)."""
    hourly = scan_hourly(inputs.met_hourly, config)
    rain = scan_rain(inputs.rain_daily, config)
    lookback = config.rain_lookback_days
    needed = places.sites.select(F.col("met_x").alias("cell_x"), F.col("met_y").alias("cell_y"))
    wanted = hourly.join(needed.distinct(), ["cell_x", "cell_y"], "left_semi")
    rained = places.sites.select(F.col("rain_x").alias("cell_x"), F.col("rain_y").alias("cell_y"))
    wanted_rain = rain.join(rained.distinct(), ["cell_x", "cell_y"], "left_semi")
    return attach_weather(
        observations,
        period_weather(hourly_derived(wanted), periods),
        period_rain(wanted_rain, periods, lookback),
        period_counts(hourly, rain, periods, lookback),
        places.era5_support_m,
        places.chirps_support_m,
    )


def needed_cells(valid: DataFrame, bridge: DataFrame) -> DataFrame:
    """Period cells that the statistics of valid observations read: a row per period and patch, with
    the cells as `bits`.
    """
    zones = unfold_scales(valid).select(
        F.col("zone_id").alias("geom_id"), "scale", F.col("period_date").alias("period_start")
    )
    placed = with_patch(bridge.select("geom_id", "scale", "cell_x", "cell_y"))
    return (
        zones.distinct()
        .join(placed, ["geom_id", "scale"])
        .groupBy("period_start", *PATCH)
        .agg(F.bit_or("bit").alias("bits"))
    )


def composite_statistics(clear: DataFrame, radar: DataFrame, bridge: DataFrame) -> DataFrame:
    """The 32 statistics per geometry, scale and period, from clear optical and from radar pixels.

    Optical and radar composites stay apart down to the statistics: their masks are independent,
    and joining statistics is far smaller than joining pixels.
    """
    bands = list(OPTICAL_BANDS)

    def optical(pixels: DataFrame) -> DataFrame:
        return optical_predictors(medoid(daily_stack(pixels, bands), bands))

    sources = [
        Source(dealt_pixels(clear, bands), optical, OPTICAL_PREDICTORS),
        Source(dealt_passes(radar), radar_medians, RADAR_PREDICTORS),
    ]
    return statistics_of(sources, bridge)


def predictor_statistics(
    valid: DataFrame,
    inputs: Inputs,
    places: Places,
    config: AnalysisConfig,
    periods: DataFrame,
) -> DataFrame:
    """The statistics from pixels of valid observations only.

    What they need is written first: a list that is short for its size then meets the pixels without
    a shuffle of them.
    """
    needed = written(needed_cells(valid, places.bridge), "needed-cells")
    bounds = bounds_of(places.bridge)
    clear = clear_rows(inputs, bounds, periods, config, needed)
    radar = radar_rows(inputs, bounds, periods, config, needed)
    return composite_statistics(clear, radar, places.bridge)


def assemble_rows(valid: DataFrame, statistics: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Valid observations with weather + statistics -> output rows with all working columns."""
    named = statistics.withColumnsRenamed({"geom_id": "zone_id", "period_start": "period_date"})
    rows = unfold_scales(valid).join(named, ["zone_id", "scale", "period_date"], "left")
    return with_row_status(with_missing_statistics(rows), config)


def build_training_tables(
    inputs: Inputs,
    places: Places,
    config: AnalysisConfig,
    work: DataFrame | None = None,
    periods: DataFrame | None = None,
) -> TrainingTables:
    """The whole pipeline. `work` (`station_id`, `year`, `quarter`) restricts it to those partitions:
    its stations, composites and dates bound every scan before any pixel is read.

    Valid observations are few and steer all heavy work, so they are written once; the scans for
    the statistics then read pixels of valid observations only. A caller that builds several tables
    of one window hands its `periods` over, so that the ET table is not read for them again.
    """
    periods = periods_of(inputs, config) if periods is None else periods
    if work is not None:
        work = work.select("station_id", "year", "quarter").distinct()
        places = of_stations(places, work)
        periods = written(of_quarters(periods, work), "periods")
        config = window_of(periods, config)
    table = valid_observations(availability(inputs, places, config, periods))
    if work is not None:
        day = F.col("period_date")
        keyed = table.withColumns({"year": F.year(day), "quarter": quarter_label(day)})
        table = keyed.join(work, PARTITION, "left_semi").drop("year", "quarter")
    valid = written(table, "valid-observations")
    weather_keyed = valid.withColumnRenamed("period_start", "period_text").withColumn(
        "period_start", F.col("period_date")
    )
    with_weather = (
        meteorology(weather_keyed, inputs, places, config, periods)
        .drop("period_start")
        .withColumnRenamed("period_text", "period_start")
    )
    statistics = predictor_statistics(valid, inputs, places, config, periods)
    return TrainingTables(output_columns(assemble_rows(with_weather, statistics, config)))
