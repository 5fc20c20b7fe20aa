"""The tables that the plans read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Inputs:
    """Logical input tables, in the schemas of `terraloom.schemas`."""

    et_pixels: DataFrame
    optical_pixels: DataFrame
    cloud_pixels: DataFrame
    sar_scenes: DataFrame
    sar_pixels: DataFrame
    met_hourly: DataFrame
    rain_daily: DataFrame


@dataclass(frozen=True)
class Places:
    """Stations resolved onto all grids, and the bridge from geometries to analysis cells.

    `sites` holds per station: its attributes, ET cell (`cell_x`, `cell_y`), `modis_pixel_id`,
    `geom_id`, `footprint_area_m2`, weather support (`met_x`, `met_y` and the sampling columns) and
    rain cell (`rain_x`, `rain_y`).
    """

    sites: DataFrame
    bridge: DataFrame
    era5_support_m: float
    chirps_support_m: float
