"""Radar imagery: period medians in dB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.operators.optical import PERIOD_CELL
from terraloom.operators.zonal import PATCH, by_patch


def once_per_scene(value: Column) -> Column:
    """`value` of a period cell's aggregation, or an error if a scene gave the cell two pixels.

    A repeated pixel would bias a median unseen. The check costs no shuffle of its own: it counts in
    the aggregation that reads the rows anyway, and a cell sees few scenes in a period.
    """
    scenes, rows = F.size(F.collect_set("scene_id")), F.count("scene_id")
    where = [F.col(c).cast("string") for c in PERIOD_CELL]
    said = [F.lit("sar_pixels holds"), rows.cast("string"), F.lit("rows of"), scenes.cast("string")]
    message = F.concat_ws(" ", *said, F.lit("scenes at"), *where)
    return F.when(scenes == rows, value).otherwise(F.raise_error(message))


RADAR_BANDS = ["vv", "vh", "angle"]


def dealt_passes(rows: DataFrame) -> DataFrame:
    """Radar pixels by patch, with what the medians read; those that carry a patch have been dealt."""
    if set(PATCH) <= set(rows.columns):
        return rows
    return by_patch(rows.select(*PERIOD_CELL, "scene_id", *RADAR_BANDS))


def radar_medians(rows: DataFrame) -> DataFrame:
    """Per period and cell: medians of each band over its own valid pixels.

    A group holds the passes of one orbit over one cell within eight days; a scene that holds a cell
    twice is an error. VV minus VH is the difference of the two medians, not the median of
    differences. The only shuffle is by patch, which the result carries for zones that follow.
    """
    medians = dealt_passes(rows).groupBy(*PATCH, *PERIOD_CELL).agg(
        *[once_per_scene(F.median(band)).alias(band) for band in RADAR_BANDS]
    )
    return medians.select(
        *PATCH,
        *PERIOD_CELL,
        F.col("vv").alias("VV_dB"),
        F.col("vh").alias("VH_dB"),
        (F.col("vv") - F.col("vh")).alias("VV_minus_VH_dB"),
        F.col("angle").alias("Angle_deg"),
    )
