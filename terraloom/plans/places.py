"""Stations -> sites and bridge, from coordinates and grid definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.config import AnalysisConfig
from terraloom.operators.stations import (
    cell_of,
    first_valid_cells,
    footprint_cells,
    local_cells,
    nearest_cells,
    require_supports,
    station_cells,
)
from terraloom.operators.storage import written
from terraloom.plans.geometry_store import GeometryStore
from terraloom.plans.inputs import Inputs, Places
from terraloom.sources.grids import read_grid
from terraloom.sources.scans import scan_hourly, scan_stations


def resolve_places(
    stations: DataFrame,
    grids: DataFrame,
    inputs: Inputs,
    config: AnalysisConfig,
    store: GeometryStore | None = None,
) -> Places:
    """Grid ids: `et`, `analysis`, `met`, `rain`.

    Both results are written once: every later stage joins them, and their real sizes then decide
    how. With a store, geometries that an earlier run resolved are read from it.
    """
    et_grid, analysis, met, rain = (read_grid(grids, g) for g in ("et", "analysis", "met", "rain"))
    stations = scan_stations(stations)
    hourly = scan_hourly(inputs.met_hourly, config)
    valid = first_valid_cells(hourly)
    if store is None:
        found = nearest_cells(stations, valid, met, config.support_radius_m)
    else:
        # One value reaches the driver.
        first_hour = hourly.agg(F.min("hour")).head()[0]
        found = store.supports(stations, valid, met, config.support_radius_m, first_hour)
    supports = written(found, "supports")
    require_supports(stations, supports)
    placed = cell_of(station_cells(stations, et_grid), rain, "rain_x", "rain_y")
    sites = written(placed.join(supports, "station_id"), "sites")
    et_cells, half_width = sites.select("cell_x", "cell_y"), config.local_half_width_m
    if store is None:
        footprints = footprint_cells(et_cells, et_grid, analysis, config.footprint_samples)
        boxes = local_cells(sites, analysis, half_width)
    else:
        footprints = store.footprints(et_cells, et_grid, analysis, config.footprint_samples)
        boxes = store.boxes(sites, analysis, half_width)
    bridge = written(footprints.unionByName(boxes), "bridge")
    return Places(sites, bridge, met.scale_m, rain.scale_m)
