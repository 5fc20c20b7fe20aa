"""Observation rows: ET values, validity flags, and the two output rows per observation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.config import AnalysisConfig
from terraloom.functions.calendar import epoch_millis, last_day, number_days, period_end
from terraloom.functions.et_quality import cloud_code, et_per_day, et_period, good_flag
from terraloom.functions.masks import flag, missing_count, missing_names
from terraloom.schemas import (
    MISSING_STATISTIC,
    OUTPUT_SCHEMA,
    SCALES,
    STATISTICS,
    TARGET_SUPPORT,
)


def with_et_values(frame: DataFrame) -> DataFrame:
    """ET per period and day, quality flag and code. Bad quality keeps its values."""
    dn, qc = F.col("et_dn"), F.col("et_qc")
    return frame.withColumns(
        {
            "ET_mm_period": et_period(dn),
            "ET_mm_day": et_per_day(dn, number_days(F.col("period_start"))),
            "modis_good": good_flag(dn, qc),
            "modis_scf_qc": cloud_code(qc),
        }
    )


def single(frame: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows of `frame`, which holds one per `keys`; a second one is an error when it is read.

    Shuffled on the keys, so a join on them that follows needs no shuffle of its own.
    """
    rows = F.count(F.lit(1))
    where = [F.col(k).cast("string") for k in keys]
    message = F.concat_ws(" ", F.lit(f"{name} holds"), rows.cast("string"), F.lit("rows at"), *where)
    values = [
        F.when(rows == 1, F.first(c)).otherwise(F.raise_error(message)).alias(c)
        for c in frame.columns
        if c not in keys
    ]
    return frame.groupBy(*keys).agg(*values)


def et_at_sites(
    observations: DataFrame, et_pixels: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """The ET pixel of each observation's own cell and period; absent pixels leave NULLs. `keys` may
    name more columns, by which both sides are dealt.
    """
    keys = ["period_start", "cell_x", "cell_y"] if keys is None else keys
    joined = observations.join(et_pixels, keys, "left")
    return with_et_values(joined).drop("et_dn", "et_qc")


def within_window(start: Column, window_end: date) -> Column:
    return period_end(start) <= F.lit(window_end)


def with_validity(frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Flags from `modis_good`, the coverage shares and the product count."""
    frame = frame.withColumns(
        {
            "s2_valid": flag(F.col("s2_share") >= config.optical_coverage),
            "s1_valid": flag(
                (F.col("s1_products_total") > 0) & (F.col("s1_share") >= config.radar_coverage)
            ),
        }
    )
    valid = (
        (F.col("modis_good") == 1)
        & (F.col("s2_valid") == 1)
        & (F.col("s1_valid") == 1)
        & within_window(F.col("period_start"), config.end)
    )
    return frame.withColumn("valid_observation", flag(valid))


def with_period_columns(frame: DataFrame) -> DataFrame:
    """Output spelling of the period; the DATE stays as `period_date`."""
    start = F.col("period_date")
    return frame.withColumnRenamed("period_start", "period_date").withColumns(
        {
            "period_start": start.cast("string"),
            "period_end": last_day(start).cast("string"),
            "number_days": number_days(start),
            "target_support": F.lit(TARGET_SUPPORT),
            "system:time_start": epoch_millis(start),
        }
    )


def unfold_scales(observations: DataFrame) -> DataFrame:
    """Two rows per observation, one per support, from a single read of the observations."""
    rows = F.array(
        *[
            F.struct(
                F.lit(scale).alias("scale"),
                F.lit(support).alias("predictor_support"),
                # The footprint belongs to the ET cell, the local box to the station.
                (F.col("geom_id") if scale == "footprint" else F.col("station_id")).alias("zone_id"),
            )
            for scale, support in SCALES.items()
        ]
    )
    unfolded = observations.withColumn("__row", F.explode(rows))
    return unfolded.select("*", "__row.*").drop("__row")


def with_missing_statistics(frame: DataFrame, statistics: list[str] | None = None) -> DataFrame:
    """Count and name the absent statistics, then fill them."""
    statistics = STATISTICS if statistics is None else statistics
    counted = frame.withColumns(
        {
            "statistics_missing": missing_count(statistics),
            "missing_keys": missing_names(statistics),
        }
    )
    return counted.fillna(MISSING_STATISTIC, subset=statistics)


def with_row_status(frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    complete = (F.col("statistics_missing") == 0) & (F.col("meteo_complete") == 1)
    return frame.withColumns(
        {
            "s1_pass": F.lit(config.radar_pass),
            "s1_relative_orbit": F.lit(config.radar_orbit),
            "missing_stats_count": F.col("statistics_missing") + F.col("meteo_missing_count"),
            "stats_complete": flag(complete),
        }
    )


def output_columns(frame: DataFrame) -> DataFrame:
    """The output contract: names, order and types."""
    return frame.selectExpr(
        *[f"cast(`{f.name}` as {f.dataType.simpleString()}) as `{f.name}`" for f in OUTPUT_SCHEMA]
    )
