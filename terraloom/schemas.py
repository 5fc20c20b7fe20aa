"""Table contracts: logical inputs, band lists and the 83 output columns."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def columns(spec: str) -> T.StructType:
    """A schema from "name type, name type, ..."; unlike a DDL string it needs no session."""
    pairs = [item.split() for item in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Optical source bands and the predictor names they become.
OPTICAL_BANDS = {
    "b2": "Blue",
    "b3": "Green",
    "b4": "Red",
    "b5": "RedEdge1",
    "b6": "RedEdge2",
    "b7": "RedEdge3",
    "b8a": "NIR",
    "b11": "SWIR1",
    "b12": "SWIR2",
}
# Normalised differences (a - b) / (a + b).
INDEX_BANDS = {
    "NDVI": ("NIR", "Red"),
    "NDMI": ("NIR", "SWIR1"),
    "NDWI": ("Green", "NIR"),
}
# Radar predictors.
RADAR_PREDICTORS = ["VV_dB", "VH_dB", "VV_minus_VH_dB", "Angle_deg"]

OPTICAL_PREDICTORS = [*OPTICAL_BANDS.values(), *INDEX_BANDS]
PREDICTORS = [*OPTICAL_PREDICTORS, *RADAR_PREDICTORS]

# Values near the middle of what a predictor can hold; differences from them are summed. Indices lie
# around 0, which is also what any other band gets.
PREDICTOR_SHIFTS = dict.fromkeys(OPTICAL_BANDS.values(), 0.2) | {
    "VV_dB": -12.0,
    "VH_dB": -19.0,
    "VV_minus_VH_dB": 7.0,
    "Angle_deg": 38.0,
}

# Meteorological predictors counted as missing when NULL.
WEATHER_COLUMNS = [
    "Tair_mean_C",
    "Tair_max_C",
    "VPD_mean_kPa",
    "VPD_max_kPa",
    "SolarRad_MJ_m2_day",
    "Wind_mean_ms",
    "Precip_period_mm",
    "Precip_prev30d_mm",
]

MISSING_STATISTIC = -9999.0
TARGET_SUPPORT = "MODIS_footprint"
SAMPLING_METHOD = "nearest_valid_land_pixel"
# Output row kinds and the support each one describes.
SCALES = {"footprint": "MODIS_footprint", "local_60m": "60m_x_60m"}


def statistic_columns(bands: list[str]) -> list[str]:
    return [f"{band}_{stat}" for band in bands for stat in ("mean", "stdDev")]


STATISTICS = statistic_columns(PREDICTORS)

# Name and type of the base output columns, in output order.
_BASE = """
station string, station_id string, longitude double, latitude double,
modis_pixel_id bigint, footprint_area_m2 double,
period_start string, period_end string, number_days int,
ET_mm_period double, ET_mm_day double, modis_good int, modis_scf_qc int,
s2_dates_total int, s2_dates string, s2_union_coverage_pct double,
s1_dates_total int, s1_dates string, s1_products_total int, s1_union_coverage_pct double,
s1_pass string, s1_relative_orbit int,
Tair_mean_C double, Tair_max_C double, VPD_mean_kPa double, VPD_max_kPa double,
SolarRad_MJ_m2_day double, Wind_mean_ms double, Precip_period_mm double, Precip_prev30d_mm double,
era5_hours_total int, era5_hours_expected int, chirps_days_period int, chirps_days_expected int,
chirps_days_prev30 int, chirps_days_prev30_expected int,
era5_support_m double, chirps_support_m double, era5_sampling_method string,
era5_sampling_longitude double, era5_sampling_latitude double, era5_sampling_distance_m double,
meteo_missing_count int, meteo_temporal_complete int, meteo_complete int,
scale string, predictor_support string, target_support string,
missing_stats_count int, stats_complete int, system:time_start bigint
"""
BASE_SCHEMA = columns(_BASE)
# Set per output row; every other base column belongs to the observation.
ROW_COLUMNS = [
    "s1_pass",
    "s1_relative_orbit",
    "scale",
    "predictor_support",
    "missing_stats_count",
    "stats_complete",
]
OBSERVATION_COLUMNS = [c for c in BASE_SCHEMA.names if c not in ROW_COLUMNS]
OUTPUT_SCHEMA = T.StructType(
    BASE_SCHEMA.fields + [T.StructField(c, T.DoubleType()) for c in STATISTICS]
)

STATIONS = columns(
    "station_id string, station string, longitude double, latitude double"
)
GRIDS = columns(
    "grid_id string, kind string, origin_x double, origin_y double, "
    "step_x double, step_y double, scale_m double"
)
# Large pixel tables are best stored by month and tile (`sources.layout`): the window then prunes
# months and the geometries prune tiles before a file is opened.
ET_PIXELS = columns(
    "period_start date, cell_x bigint, cell_y bigint, et_dn int, et_qc int"
)
OPTICAL_PIXELS = columns(
    "scene_id string, ts timestamp_ntz, mgrs_tile string, cell_x bigint, cell_y bigint, "
    + ", ".join(f"{band} int" for band in OPTICAL_BANDS)
)
CLOUD_PIXELS = columns(
    "scene_id string, ts timestamp_ntz, cell_x bigint, cell_y bigint, cs_cdf double"
)
SAR_SCENES = columns(
    "scene_id string, ts timestamp_ntz, mode string, pass string, rel_orbit int, pols array<string>"
)
# `ts` is that of the scene: it lets the window prune pixels before they meet the catalogue.
SAR_PIXELS = columns(
    "scene_id string, ts timestamp_ntz, cell_x bigint, cell_y bigint, vv double, vh double, angle double"
)
MET_HOURLY = columns(
    "hour timestamp_ntz, cell_x bigint, cell_y bigint, "
    "t2m double, d2m double, u10 double, v10 double, ssrd double"
)
RAIN_DAILY = columns(
    "day date, cell_x bigint, cell_y bigint, precipitation double"
)
GEOMETRY_CELLS = columns(
    "geom_id string, scale string, cell_x bigint, cell_y bigint, weight double"
)
