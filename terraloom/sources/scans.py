"""Scans of the input tables.

Each scan is a filter and a column list over a table, so that both reach the file reader. The
spatial restriction is separate (`operators.bounds`) because it is a join; a table stored by tile
(`sources.layout`) keeps its tile columns up to it.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.config import AnalysisConfig
from terraloom.functions.calendar import half_open
from terraloom.functions.masks import nan_as_null
from terraloom.schemas import OPTICAL_BANDS
from terraloom.sources.layout import in_window, layout_columns


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read parquet, csv, orc or json with a declared schema; nothing is inferred."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def scan_stations(stations: DataFrame) -> DataFrame:
    return stations.select("station_id", "station", "longitude", "latitude")


def scan_et(et_pixels: DataFrame, config: AnalysisConfig) -> DataFrame:
    return in_window(et_pixels, "period_start", config.start, config.end).select(
        "period_start", "cell_x", "cell_y", "et_dn", "et_qc"
    )


def scan_optical(
    pixels: DataFrame, config: AnalysisConfig, bands: list[str] | None = None
) -> DataFrame:
    bands = list(OPTICAL_BANDS) if bands is None else bands
    return in_window(pixels, "ts", config.start, config.end).select(
        "scene_id", "ts", "mgrs_tile", "cell_x", "cell_y", *bands, *layout_columns(pixels)
    )


def scan_cloud(cloud: DataFrame, config: AnalysisConfig) -> DataFrame:
    return in_window(cloud, "ts", config.start, config.end).select(
        "scene_id", "ts", "cell_x", "cell_y", "cs_cdf", *layout_columns(cloud)
    )


def select_radar_scenes(scenes: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Scenes of the wanted mode, pass and orbit that carry both polarisations."""
    return scenes.filter(
        half_open(F.col("ts"), config.start, config.end)
        & (F.col("mode") == config.radar_mode)
        & (F.col("pass") == config.radar_pass)
        & (F.col("rel_orbit") == config.radar_orbit)
        & F.array_contains("pols", "VV")
        & F.array_contains("pols", "VH")
    ).select("scene_id", "ts")


def scan_radar(scenes: DataFrame, pixels: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Pixels of the selected scenes. The planner picks the join from the catalogue's real size."""
    dated = in_window(pixels, "ts", config.start, config.end)
    bands = nan_as_null(
        dated.select("scene_id", "cell_x", "cell_y", "vv", "vh", "angle", *layout_columns(pixels))
    )
    return bands.join(select_radar_scenes(scenes, config), "scene_id")


def scan_hourly(hourly: DataFrame, config: AnalysisConfig) -> DataFrame:
    window = hourly.filter(half_open(F.col("hour"), config.start, config.end))
    return nan_as_null(
        window.select("hour", "cell_x", "cell_y", "t2m", "d2m", "u10", "v10", "ssrd")
    )


def scan_rain(rain: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Daily rain, from the look-back before the window on."""
    first = config.start - timedelta(days=config.rain_lookback_days)
    window = rain.filter(half_open(F.col("day"), first, config.end))
    return nan_as_null(window.select("day", "cell_x", "cell_y", "precipitation"))
