"""Which observations can be used: ET quality, optical and radar coverage, window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.config import AnalysisConfig
from terraloom.functions.masks import all_present, or_zero
from terraloom.operators.bounds import Bounds, bounds_of
from terraloom.operators.observations import (
    et_at_sites,
    single,
    with_period_columns,
    with_validity,
)
from terraloom.operators.optical import SCENE_CELL, clear_pixels, is_clear
from terraloom.operators.periods import assign_period, composite_periods
from terraloom.operators.resample import resample_bilinear, source_blocks
from terraloom.operators.stations import observation_grid
from terraloom.operators.storage import written
from terraloom.operators.zonal import PATCH, footprint_cells_of, with_patch, zone_summary
from terraloom.plans.inputs import Inputs, Places
from terraloom.schemas import OPTICAL_BANDS
from terraloom.sources.scans import scan_cloud, scan_et, scan_optical, scan_radar


def periods_of(inputs: Inputs, config: AnalysisConfig) -> DataFrame:
    """The composites of the window, written once: many joins of one run read this short list."""
    return written(composite_periods(scan_et(inputs.et_pixels, config)), "periods")


def on_analysis_grid(pixels: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Optical pixels resampled from their own grid. Numbers become integers again, so that medoid
    scores stay exact.
    """
    bands = list(OPTICAL_BANDS)
    scene = ["scene_id", "ts", "mgrs_tile"]
    blended = resample_bilinear(pixels, bands, config.optical_grid, config.analysis_grid, scene)
    # Weights are not exact in binary: what is meant to be half must not fall below it.
    whole = {b: F.floor(F.col(b) + F.lit(0.5 + 1e-6)).cast("int") for b in bands}
    return blended.withColumns(whole)


def optical_pixels(inputs: Inputs, bounds: Bounds, config: AnalysisConfig) -> DataFrame:
    """Optical pixels of the window in the blocks of the geometries, on the analysis grid.

    Resampled only if the run asks for it: then the source is cut to the blocks that the wanted ones
    draw on before its pixels are spread.
    """
    pixels = scan_optical(inputs.optical_pixels, config)
    if config.optical_grid is None:
        return bounds.near(pixels)
    drawn_on = source_blocks(bounds, config.optical_grid, config.analysis_grid)
    return bounds.near(on_analysis_grid(drawn_on.near(pixels), config))


def optical_rows(
    inputs: Inputs, bounds: Bounds, periods: DataFrame, config: AnalysisConfig
) -> DataFrame:
    """Optical pixels in the blocks of the geometries, with their day and period.

    What follows joins the geometries' own cells, so no exact restriction is needed here.
    """
    return assign_period(optical_pixels(inputs, bounds, config), "ts", periods)


def _needed_only(rows: DataFrame, needed: DataFrame | None) -> DataFrame:
    """Rows on a needed period cell, one bit of its patch (`training.needed_cells`)."""
    if needed is None:
        return rows
    found = with_patch(rows).join(needed, ["period_start", *PATCH])
    return found.filter(F.col("bit").bitwiseAND(F.col("bits")) != 0).select(*rows.columns)


def clear_rows(
    inputs: Inputs,
    bounds: Bounds,
    periods: DataFrame,
    config: AnalysisConfig,
    needed: DataFrame | None = None,
) -> DataFrame:
    """Valid optical pixels in the blocks of the geometries, of the `needed` cells' bits if given.

    Both sides of the scene join are restricted and screened before it. A cloud score carries the
    time of its scene, so it belongs to the same period.
    """
    rows = _needed_only(optical_rows(inputs, bounds, periods, config), needed)
    cloud = bounds.near(scan_cloud(inputs.cloud_pixels, config))
    if needed is not None:
        cloud = _needed_only(assign_period(cloud, "ts", periods), needed)
    return clear_pixels(rows, cloud, list(OPTICAL_BANDS), config.clear_threshold)


def radar_rows(
    inputs: Inputs,
    bounds: Bounds,
    periods: DataFrame,
    config: AnalysisConfig,
    needed: DataFrame | None = None,
) -> DataFrame:
    """Pixels of the selected radar scenes in the geometries' blocks, of `needed` cells if given."""
    near = bounds.near(scan_radar(inputs.sar_scenes, inputs.sar_pixels, config))
    return _needed_only(assign_period(near, "ts", periods), needed)


def optical_zones(
    inputs: Inputs, bounds: Bounds, periods: DataFrame, footprints: DataFrame, config: AnalysisConfig
) -> DataFrame:
    """Optical coverage and scene dates: one scan of the pixels and one of the cloud scores."""
    rows = optical_rows(inputs, bounds, periods, config).select(
        *SCENE_CELL, "dd", "period_start", all_present(list(OPTICAL_BANDS)).alias("present")
    )
    clear = (
        bounds.near(scan_cloud(inputs.cloud_pixels, config))
        .filter(is_clear(config.clear_threshold))
        .select(*SCENE_CELL, F.lit(True).alias("clear"))
    )
    flagged = rows.join(clear, SCENE_CELL, "left")
    return zone_summary(flagged, [F.col("present") & F.coalesce("clear", F.lit(False))], footprints)


def radar_zones(
    inputs: Inputs, bounds: Bounds, periods: DataFrame, footprints: DataFrame, config: AnalysisConfig
) -> DataFrame:
    """Radar coverage and scene dates from one scan of the pixels, which also finds repeated ones."""
    rows = radar_rows(inputs, bounds, periods, config)
    masks = [F.col("vv").isNotNull(), F.col("vh").isNotNull()]
    return zone_summary(rows, masks, footprints, once="sar_pixels")


def availability(
    inputs: Inputs, places: Places, config: AnalysisConfig, periods: DataFrame | None = None
) -> DataFrame:
    """One row per site and composite.

    Coverage and scene dates are computed per footprint, so stations in one ET cell share them.
    Pixel values stay out of this stage: only masks and keys are shuffled.
    """
    periods = periods_of(inputs, config) if periods is None else periods
    footprints = footprint_cells_of(places.bridge)
    bounds = bounds_of(footprints)
    optical = optical_zones(inputs, bounds, periods, footprints, config)
    radar = radar_zones(inputs, bounds, periods, footprints, config)

    zone = ["geom_id", "period_start"]
    # Only the sites' own ET cells travel to the observations, dealt by geometry like all that follows.
    own = places.sites.select("cell_x", "cell_y", "geom_id").distinct()
    et = scan_et(inputs.et_pixels, config).join(own, ["cell_x", "cell_y"]).repartition("geom_id")
    et = single(et, [*zone, "cell_x", "cell_y"], "et_pixels")
    # Sites are dealt out before they unfold into observations, so those are never shuffled. Their
    # rows are sites times periods, of which a size estimate sees the sites alone: without the hints
    # they may be taken for a short list and broadcast through the driver.
    grid = observation_grid(places.sites.repartition("geom_id"), periods).hint("merge")
    observed = et_at_sites(grid, et, [*zone, "cell_x", "cell_y"]).hint("merge")
    names = ("share", "dates_total", "dates", "products_total")
    seen = optical.withColumnsRenamed({c: f"s2_{c}" for c in names}).drop("s2_products_total")
    joined = observed.join(seen, zone, "left").hint("merge")
    joined = joined.join(radar.withColumnsRenamed({c: f"s1_{c}" for c in names}), zone, "left")
    filled = joined.withColumns(
        {
            **{c: or_zero(F.col(c), 0.0) for c in ("s2_share", "s1_share")},
            **{
                c: or_zero(F.col(c))
                for c in ("s2_dates_total", "s1_dates_total", "s1_products_total")
            },
            **{c: or_zero(F.col(c), "") for c in ("s2_dates", "s1_dates")},
        }
    )
    rated = with_validity(filled, config).withColumns(
        {
            "s2_union_coverage_pct": F.col("s2_share") * 100,
            "s1_union_coverage_pct": F.col("s1_share") * 100,
        }
    )
    return with_period_columns(rated.drop("s2_share", "s1_share"))


def valid_observations(table: DataFrame) -> DataFrame:
    return table.filter(F.col("valid_observation") == 1)
