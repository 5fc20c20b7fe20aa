"""Registered queries. Each one runs library code over the whole stand-in tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.functions import atmosphere, calendar
from terraloom.operators import (
    observations,
    optical,
    periods,
    radar,
    stations,
    weather,
    worklist,
    zonal,
)
from terraloom.operators.bounds import Bounds, bounds_of
from terraloom.operators.medians import spread_medians
from terraloom.operators.resample import resample_bilinear
from terraloom.plans import availability as avail
from terraloom.plans import training
from terraloom.plans.places import resolve_places
from terraloom.schemas import (
    GRIDS,
    OPTICAL_BANDS,
    OUTPUT_SCHEMA,
    PREDICTORS,
    STATISTICS,
    WEATHER_COLUMNS,
)
from terraloom.sources import scans
from terraloom.sources.grids import Grid
from terraloom.sources.sinks import output_summary
from workloads import standins
from workloads.standins import ANALYSIS_GRID, CONFIG, ET_GRID, MET_GRID

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
BANDS = list(OPTICAL_BANDS)
# Radius at which some stations find no valid weather cell.
SHORT_RADIUS_M = 6_000.0
COLUMNS_FROM = Grid("stored", "utm18n", 0.0, 0.0, 20.0, 30.0, 30.0)
COLUMNS_TO = Grid("analysis", "utm18n", 0.0, 0.0, 20.0, 20.0, 20.0)
#: First day of the resumed work list.
RESUME_FROM = date(1998, 1, 1)
RESAMPLE_FROM = Grid("coarse", "utm18n", 0.0, 0.0, 30.0, 30.0, 30.0)
RESAMPLE_TO = Grid("fine", "utm18n", 5.0, 15.0, 20.0, 20.0, 20.0)


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def rounded(frame: DataFrame) -> DataFrame:
    """Round doubles to six places, the precision of the comparison; adding 0.0 drops a minus zero."""
    return frame.selectExpr(
        *[
            f"round(`{f.name}`, 6) + 0D as `{f.name}`"
            if isinstance(f.dataType, T.DoubleType)
            else f"`{f.name}`"
            for f in frame.schema.fields
        ]
    )


def _periods(spark: SparkSession, sf: str) -> DataFrame:
    return periods.composite_periods(scans.scan_et(standins.et_pixels(spark, sf), CONFIG))


def _footprints(spark: SparkSession, sf: str) -> DataFrame:
    return zonal.footprint_cells_of(standins.bridge(spark, sf))


def _bounds(spark: SparkSession, sf: str) -> Bounds:
    return bounds_of(_footprints(spark, sf))


def _clear(spark: SparkSession, sf: str) -> DataFrame:
    ins = standins.inputs(spark, sf)
    return avail.clear_rows(ins, _bounds(spark, sf), _periods(spark, sf), CONFIG)


def _radar(spark: SparkSession, sf: str) -> DataFrame:
    ins = standins.inputs(spark, sf)
    return avail.radar_rows(ins, _bounds(spark, sf), _periods(spark, sf), CONFIG)


# Scans and filters


@query
def q_scan_et(spark, sf):
    return scans.scan_et(standins.et_pixels(spark, sf), CONFIG).orderBy("period_start")


@query
def q_scan_stations(spark, sf):
    return rounded(scans.scan_stations(standins.stations(spark, sf)))


@query
def q_scan_optical(spark, sf):
    pixels = scans.scan_optical(standins.optical_pixels(spark, sf), CONFIG)
    return _bounds(spark, sf).restrict(pixels)


@query
def q_optical_resampled(spark, sf):
    """The optical scan with resampling switched on; columns align, rows are 30 m and become 20 m."""
    config = replace(CONFIG, optical_grid=COLUMNS_FROM, analysis_grid=COLUMNS_TO)
    pixels = scans.scan_optical(standins.optical_pixels(spark, sf), config)
    return avail.on_analysis_grid(pixels, config).filter("b2 is not null")


@query
def q_scan_radar(spark, sf):
    return rounded(
        scans.scan_radar(standins.sar_scenes(spark, sf), standins.sar_pixels(spark, sf), CONFIG)
    )


@query
def q_scan_hourly(spark, sf):
    return rounded(scans.scan_hourly(standins.met_hourly(spark, sf), CONFIG))


@query
def q_scan_rain_lookback(spark, sf):
    return rounded(scans.scan_rain(standins.rain_daily(spark, sf), CONFIG))


@query
def q_filter_halfopen(spark, sf):
    inside = calendar.half_open(F.col("ts"), CONFIG.start, CONFIG.end)
    return standins.sar_scenes(spark, sf).filter(inside).select("scene_id", "ts")


@query
def q_filter_bounds(spark, sf):
    boxes = standins.bridge(spark, sf).filter(F.col("scale") == "local_60m")
    pixels = standins.cloud_pixels(spark, sf)
    return rounded(
        bounds_of(boxes).restrict(pixels).select("scene_id", "cell_x", "cell_y", "cs_cdf")
    )


@query
def q_date_key(spark, sf):
    return standins.sar_scenes(spark, sf).select(
        "scene_id", calendar.date_key(F.col("ts")).alias("date_key")
    )


# Evapotranspiration, calendar, identifiers


@query
def q_et_quality(spark, sf):
    rated = observations.with_et_values(standins.et_pixels(spark, sf))
    return rated.select("period_start", "cell_x", "et_dn", "et_qc", "modis_good", "modis_scf_qc")


@query
def q_et_scale(spark, sf):
    rated = observations.with_et_values(standins.et_pixels(spark, sf))
    return rounded(rated.select("period_start", "cell_x", "ET_mm_period", "ET_mm_day"))


@query
def q_period_end(spark, sf):
    start = F.col("period_start")
    found = periods.composite_periods(standins.et_pixels(spark, sf))
    return periods.with_bounds(found).withColumns(
        {
            "last_day": calendar.last_day(start).cast("string"),
            "start_millis": calendar.epoch_millis(start),
        }
    )


@query
def q_pixel_id(spark, sf):
    placed = stations.station_cells(standins.stations(spark, sf), ET_GRID)
    return placed.select("station_id", "cell_x", "cell_y", "modis_pixel_id")


@query
def q_station_cell(spark, sf):
    placed = stations.station_cells(standins.stations(spark, sf), ET_GRID)
    return rounded(
        placed.select(
            "station_id", "longitude", "latitude", "modis_pixel_id", "footprint_area_m2"
        )
    )


@query
def q_cell_grid(spark, sf):
    placed = stations.station_cells(standins.stations(spark, sf), ET_GRID)
    return stations.cell_neighbourhood(placed, reach=2)


@query
def q_station_index(spark, sf):
    return stations.station_index(standins.stations(spark, sf))


@query
def q_obs_grid(spark, sf):
    grid = stations.observation_grid(standins.sites(spark, sf), _periods(spark, sf))
    return grid.select("station_id", "modis_pixel_id", "period_start")


@query
def q_et_at_station(spark, sf):
    grid = stations.observation_grid(standins.sites(spark, sf), _periods(spark, sf))
    et = scans.scan_et(standins.et_pixels(spark, sf), CONFIG)
    return rounded(
        observations.et_at_sites(grid, et).select(
            "station_id", "period_start", "ET_mm_period", "ET_mm_day", "modis_good", "modis_scf_qc"
        )
    )


# Weather


@query
def q_svp(spark, sf):
    hourly = standins.met_hourly(spark, sf)
    air, dew = atmosphere.celsius(F.col("t2m")), atmosphere.celsius(F.col("d2m"))
    return rounded(
        hourly.select(
            "hour",
            "cell_x",
            atmosphere.saturation_vapour_pressure(air).alias("svp_air_kpa"),
            atmosphere.saturation_vapour_pressure(dew).alias("svp_dew_kpa"),
        )
    )


@query
def q_hourly_derive(spark, sf):
    return rounded(weather.hourly_derived(standins.met_hourly(spark, sf)).drop("cell_y"))


@query
def q_met_period(spark, sf):
    hourly = scans.scan_hourly(standins.met_hourly(spark, sf), CONFIG)
    summary = weather.period_weather(weather.hourly_derived(hourly), _periods(spark, sf))
    return rounded(summary.drop("cell_y"))


@query
def q_met_counts(spark, sf):
    hourly = scans.scan_hourly(standins.met_hourly(spark, sf), CONFIG)
    rain = scans.scan_rain(standins.rain_daily(spark, sf), CONFIG)
    return weather.period_counts(hourly, rain, _periods(spark, sf), CONFIG.rain_lookback_days)


def _rain(spark, sf):
    rain = scans.scan_rain(standins.rain_daily(spark, sf), CONFIG)
    return weather.period_rain(rain, _periods(spark, sf), CONFIG.rain_lookback_days)


@query
def q_rain_period(spark, sf):
    found = _rain(spark, sf).filter(F.col("Precip_period_mm").isNotNull())
    return rounded(found.select("cell_x", "period_start", "Precip_period_mm"))


@query
def q_rain_prev30(spark, sf):
    found = _rain(spark, sf).filter(F.col("Precip_prev30d_mm").isNotNull())
    return rounded(found.select("cell_x", "period_start", "Precip_prev30d_mm"))


def _meteorology(spark, sf):
    ins = standins.inputs(spark, sf)
    found = avail.periods_of(ins, CONFIG)
    grid = stations.observation_grid(standins.sites(spark, sf), found)
    return training.meteorology(grid, ins, standins.places(spark, sf), CONFIG, found)


@query
def q_met_complete(spark, sf):
    return rounded(
        _meteorology(spark, sf).select(
            "station_id",
            "period_start",
            "era5_hours_total",
            "era5_hours_expected",
            "chirps_days_period",
            "chirps_days_expected",
            "chirps_days_prev30",
            "chirps_days_prev30_expected",
            "meteo_missing_count",
            "meteo_temporal_complete",
            "meteo_complete",
            "era5_support_m",
            "chirps_support_m",
            "era5_sampling_method",
        )
    )


@query
def q_meteorology(spark, sf):
    return rounded(
        _meteorology(spark, sf).select(
            "station_id",
            "period_start",
            *WEATHER_COLUMNS,
            "era5_sampling_longitude",
            "era5_sampling_latitude",
            "era5_sampling_distance_m",
            "meteo_complete",
        )
    )


@query
def q_nearest_cell(spark, sf):
    found = stations.nearest_cells(
        standins.stations(spark, sf), standins.met_cells(spark, sf), MET_GRID, CONFIG.support_radius_m
    )
    return found.select(
        "station_id",
        "met_x",
        "met_y",
        F.round("era5_sampling_longitude", 6).alias("era5_sampling_longitude"),
        F.round("era5_sampling_latitude", 6).alias("era5_sampling_latitude"),
        F.round("era5_sampling_distance_m", 3).alias("era5_sampling_distance_m"),
    )


@query
def q_nearest_cell_unresolved(spark, sf):
    places = standins.stations(spark, sf)
    found = stations.nearest_cells(places, standins.met_cells(spark, sf), MET_GRID, SHORT_RADIUS_M)
    return stations.unresolved_stations(places, found).select("station_id", "station")


# Optical imagery


@query
def q_scene_period_join(spark, sf):
    scenes = scans.select_radar_scenes(standins.sar_scenes(spark, sf), CONFIG)
    return periods.assign_period(scenes, "ts", _periods(spark, sf)).select(
        "scene_id", "dd", "period_start"
    )


@query
def q_link_cloud(spark, sf):
    linked = optical.link_cloud_score(
        standins.optical_pixels(spark, sf), standins.cloud_pixels(spark, sf)
    )
    return rounded(linked.select("scene_id", "cell_x", "cell_y", "cs_cdf"))


@query
def q_prepare_optical(spark, sf):
    linked = optical.link_cloud_score(
        standins.optical_pixels(spark, sf), standins.cloud_pixels(spark, sf)
    )
    screened = optical.screened(linked, BANDS, CONFIG.clear_threshold)
    return rounded(
        screened.select(
            "scene_id",
            "cell_x",
            "cell_y",
            "mgrs_tile",
            calendar.date_key(F.col("ts")).alias("date_key"),
            "valid",
            *[optical.reflectance(F.col(dn)).alias(name) for dn, name in OPTICAL_BANDS.items()],
        )
    )


@query
def q_daily_mosaic(spark, sf):
    stack = optical.daily_stack(_clear(spark, sf), BANDS)
    days = stack.select(*optical.PERIOD_CELL, F.explode("days").alias("day"))
    day = F.date_add("period_start", F.col("day.slot")).alias("dd")
    return days.select("period_start", day, "cell_x", "cell_y", *[f"day.{b}" for b in BANDS])


def _medoid(spark, sf):
    return optical.medoid(optical.daily_stack(_clear(spark, sf), BANDS), BANDS)


@query
def q_optical_medoid(spark, sf):
    return _medoid(spark, sf).drop(*zonal.PATCH)


@query
def q_indices(spark, sf):
    named = optical.optical_predictors(_medoid(spark, sf))
    return rounded(named.select(*optical.PERIOD_CELL, "NDVI", "NDMI", "NDWI"))


@query
def q_embedding_medoid(spark, sf):
    """The medoid rule with many bands: per label, the vector nearest to the median vector."""
    vectors = standins.table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("v")
    )
    long = vectors.select("label", F.posexplode("v").alias("dim", "x"))
    medians = spread_medians(long, ["label", "dim"], ["x"])
    # One entry per dimension: the list is as long as a vector.
    centres = medians.groupBy("label").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda entry: entry["x"]
        ).alias("centre")
    )
    gaps = F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b))
    score = F.round(F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g), 9)
    scored = vectors.join(centres, "label").select("label", "vec_id", score.alias("score"))
    best = F.min_by(F.struct("vec_id", "score"), F.struct("score", "vec_id")).alias("b")
    return rounded(scored.groupBy("label").agg(best).select("label", "b.vec_id", "b.score"))


@query
def q_resample_bilinear(spark, sf):
    blended = resample_bilinear(
        standins.raster(spark, sf), ["value"], RESAMPLE_FROM, RESAMPLE_TO, []
    )
    return rounded(blended.filter(F.col("value").isNotNull()).select("cell_x", "cell_y", "value"))


# Radar


@query
def q_radar_median(spark, sf):
    return rounded(radar.radar_medians(_radar(spark, sf)).drop(*zonal.PATCH))


# Geometry and zones


@query
def q_local_cells(spark, sf):
    return rounded(
        stations.local_cells(standins.stations(spark, sf), ANALYSIS_GRID, CONFIG.local_half_width_m)
    )


@query
def q_footprint_cells(spark, sf):
    placed = stations.station_cells(standins.stations(spark, sf), ET_GRID)
    return rounded(
        stations.footprint_cells(placed, ET_GRID, ANALYSIS_GRID, CONFIG.footprint_samples)
    )


def _resolved_places(spark, sf):
    """Stations put on all grids by the library; weather cells are valid in the first hour."""
    hour = F.lit(CONFIG.start).cast("timestamp_ntz")
    nothing = [F.lit(0.0).alias(c) for c in ("d2m", "u10", "v10", "ssrd")]
    hourly = standins.met_cells(spark, sf).select(
        hour.alias("hour"), "cell_x", "cell_y", F.lit(290.0).alias("t2m"), *nothing
    )
    named = {"et": ET_GRID, "analysis": ANALYSIS_GRID, "met": MET_GRID, "rain": MET_GRID}
    grids = spark.createDataFrame(
        [(name, *list(asdict(grid).values())[1:]) for name, grid in named.items()], GRIDS
    )
    ins = replace(standins.inputs(spark, sf), met_hourly=hourly)
    return resolve_places(standins.stations(spark, sf), grids, ins, CONFIG)


@query
def q_resolved_stats(spark, sf):
    """Statistics over true footprints and boxes, from a raster that reaches far beyond them."""
    bridge = _resolved_places(spark, sf).bridge
    wide = F.transform(F.sequence(F.lit(-96), F.lit(96), F.lit(48)), lambda d: F.col("cell_x") + d)
    raster = bridge.select(F.explode(wide).alias("cell_x"), "cell_y").distinct()
    value = ((F.col("cell_x") * 7 + F.col("cell_y") * 13) % 101).cast("double")
    inside = bounds_of(bridge).restrict(raster).select(
        F.lit(CONFIG.start).alias("period_start"), "cell_x", "cell_y", value.alias("value")
    )
    return rounded(zonal.zonal_statistics(inside, bridge, ["value"]).drop("period_start"))


def _zones(spark, sf, zones_of):
    """Coverage and scene dates of the footprints as the availability plan computes them."""
    ins, zones = standins.inputs(spark, sf), _footprints(spark, sf)
    return zones_of(ins, bounds_of(zones), avail.periods_of(ins, CONFIG), zones, CONFIG)


@query
def q_optical_coverage(spark, sf):
    found = _zones(spark, sf, avail.optical_zones).filter("share > 0")
    return rounded(found.select("geom_id", "period_start", "share"))


@query
def q_radar_coverage(spark, sf):
    found = _zones(spark, sf, avail.radar_zones).filter("share > 0")
    return rounded(found.select("geom_id", "period_start", "share"))


@query
def q_scene_dates(spark, sf):
    names = ["geom_id", "period_start", "dates_total", "dates", "products_total"]
    radar_seen = _zones(spark, sf, avail.radar_zones).select(*names)
    return _zones(spark, sf, avail.optical_zones).select(*names).unionByName(
        radar_seen.withColumn("geom_id", F.concat(F.lit("radar-"), F.col("geom_id")))
    )


def _statistics(spark, sf, scale):
    ins = standins.inputs_by_place(spark, sf)
    zones = standins.bridge(spark, sf).filter(F.col("scale") == scale)
    bounds, found = bounds_of(zones), avail.periods_of(ins, CONFIG)
    clear = avail.clear_rows(ins, bounds, found, CONFIG)
    passes = avail.radar_rows(ins, bounds, found, CONFIG)
    return rounded(training.composite_statistics(clear, passes, zones))


@query
def q_zonal_stats(spark, sf):
    return _statistics(spark, sf, "footprint")


@query
def q_local_stats(spark, sf):
    return _statistics(spark, sf, "local_60m")


# Composite pipelines


def _availability(spark, sf):
    return avail.availability(standins.inputs(spark, sf), standins.places(spark, sf), CONFIG)


@query
def q_availability(spark, sf):
    return rounded(
        _availability(spark, sf).select(
            "station_id",
            "station",
            "modis_pixel_id",
            "period_start",
            "period_end",
            "number_days",
            "ET_mm_period",
            "ET_mm_day",
            "modis_good",
            "modis_scf_qc",
            "s2_dates_total",
            "s2_dates",
            "s2_union_coverage_pct",
            "s1_dates_total",
            "s1_dates",
            "s1_products_total",
            "s1_union_coverage_pct",
            "s2_valid",
            "s1_valid",
            "valid_observation",
            "target_support",
            "system:time_start",
        )
    )


@query
def q_valid_obs(spark, sf):
    return avail.valid_observations(_availability(spark, sf)).select(
        "station_id", "period_start", "period_end", "modis_good", "s2_valid", "s1_valid"
    )


@query
def q_two_scale_rows(spark, sf):
    return observations.unfold_scales(_availability(spark, sf)).select(
        "station_id", "period_start", "scale", "predictor_support", "zone_id"
    )


@query
def q_missing_keys(spark, sf):
    """Footprints whose optical or radar part is empty: absent statistics are counted and filled."""
    found = q_zonal_stats(spark, sf)
    filled = observations.with_missing_statistics(found, STATISTICS)
    return filled.select(
        "geom_id",
        "period_start",
        "statistics_missing",
        F.array_join("missing_keys", ";").alias("missing_keys"),
        *[f"{band}_mean" for band in PREDICTORS],
    )


def training_rows(spark, sf) -> training.TrainingTables:
    return training.build_training_tables(
        standins.inputs(spark, sf), standins.places(spark, sf), CONFIG
    )


@query
def q_training_table(spark, sf):
    return rounded(training_rows(spark, sf).all)


@query
def q_training_resume(spark, sf):
    """The training table of a work list: all stations, the quarters from 1998 on."""
    span = standins.stations(spark, sf).select("station_id")
    work = worklist.with_quarters(span, F.lit(RESUME_FROM), F.lit(CONFIG.end))
    rows = training.build_training_tables(
        standins.inputs(spark, sf), standins.places(spark, sf), CONFIG, work
    )
    return rounded(rows.all)


@query
def q_export_select(spark, sf):
    final = training_rows(spark, sf).final
    return rounded(final.select(*[f"`{c}`" for c in OUTPUT_SCHEMA.names]))


@query
def q_output_summary(spark, sf):
    return output_summary(training_rows(spark, sf).all)


@query
def q_quarters(spark, sf):
    """Quarters of the span that the orders cover, clipped to it."""
    span = standins.table(spark, sf, "orders").agg(
        F.to_date(F.min("o_orderdate")).alias("span_start"),
        F.date_add(F.to_date(F.max("o_orderdate")), 1).alias("span_end"),
    )
    return worklist.with_quarters(span, F.col("span_start"), F.col("span_end")).select(
        "year", "quarter", "quarter_start", "quarter_end"
    )


@query
def q_pending_partitions(spark, sf):
    """Every station by quarter of the window, less those of every third station."""
    places = standins.stations(spark, sf)
    work = worklist.with_quarters(
        places.select("station_id", "station_key"), F.lit(CONFIG.start), F.lit(CONFIG.end)
    )
    done = work.filter(F.col("station_key") % 3 == 0)
    return worklist.pending(work, done).drop("station_key")
