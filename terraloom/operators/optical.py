"""Optical imagery: cloud screening, daily mosaic and period medoid.

Bands stay integers (stored digital numbers) up to the chosen medoid day. Scores are then exact
integers, so a tie is a real tie and the rule "earliest day wins" decides it on every engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.calendar import PERIOD_DAYS
from terraloom.functions.masks import all_present
from terraloom.functions.spectral import normalized_difference, reflectance
from terraloom.operators.zonal import PATCH, by_patch
from terraloom.schemas import INDEX_BANDS, OPTICAL_BANDS

SCENE_CELL = ["scene_id", "cell_x", "cell_y"]
PERIOD_CELL = ["period_start", "cell_x", "cell_y"]


def link_cloud_score(pixels: DataFrame, cloud: DataFrame) -> DataFrame:
    """Add the cloud score of the same scene and cell, NULL where there is none.

    Tables that carry the patch are joined by it too, and so where they were dealt by it.
    """
    dealt = PATCH if set(PATCH) <= set(pixels.columns) & set(cloud.columns) else []
    keys = [*dealt, *SCENE_CELL]
    return pixels.join(cloud.select(*keys, "cs_cdf"), keys, "left")


def is_clear(threshold: float) -> Column:
    """A missing or NaN score is not clear. Plain comparisons, so that they reach the scan."""
    score = F.col("cs_cdf")
    return (score >= F.lit(threshold)) & ~F.isnan(score)


def screened(linked: DataFrame, bands: list[str], threshold: float) -> DataFrame:
    """Every pixel with `valid` 0/1; bands of invalid pixels become NULL together."""
    valid = F.coalesce(all_present(bands) & is_clear(threshold), F.lit(False))
    flagged = linked.withColumn("valid", valid.cast("int"))
    kept = {band: F.when(F.col("valid") == 1, F.col(band)) for band in bands}
    return flagged.withColumns(kept)


def clear_pixels(
    pixels: DataFrame, cloud: DataFrame, bands: list[str], threshold: float
) -> DataFrame:
    """Only the valid pixels. Both filters sit below the join, which becomes an inner join."""
    return link_cloud_score(pixels.filter(all_present(bands)), cloud).filter(is_clear(threshold))


def _last_pixel(bands: list[str]) -> list[Column]:
    """Fields whose maximum is the last scene's pixel; the bands settle conflicting copies."""
    return [F.col("ts"), F.col("scene_id"), *[F.col(b) for b in bands]]


def dealt_pixels(clear: DataFrame, bands: list[str]) -> DataFrame:
    """Clear pixels by patch, with what the mosaic reads; those that carry a patch have been dealt."""
    if set(PATCH) <= set(clear.columns):
        return clear
    return by_patch(clear.select(*PERIOD_CELL, "dd", "ts", "scene_id", *bands))


def daily_stack(clear: DataFrame, bands: list[str]) -> DataFrame:
    """Per period and cell: `days`, the daily mosaics in date order, at most eight of them.

    One aggregation does the mosaic of all days. Its single shuffle moves clear pixels as they are,
    by patch: a cell has hardly two of them a period in one task, and a state of eight days is wider
    than both. The result carries the patch, for zones that follow.
    """
    slot = F.datediff(F.col("dd"), F.col("period_start"))
    pixel = F.struct(*_last_pixel(bands), slot.alias("slot"))
    slots = [F.max(F.when(slot == i, pixel)).alias(f"__day{i}") for i in range(PERIOD_DAYS)]
    stacked = dealt_pixels(clear, bands).groupBy(*PATCH, *PERIOD_CELL).agg(*slots)
    days = F.array_compact(F.array(*[F.col(f"__day{i}") for i in range(PERIOD_DAYS)]))
    return stacked.select(*PATCH, *PERIOD_CELL, days.alias("days"))


def medoid(stack: DataFrame, bands: list[str]) -> DataFrame:
    """The day nearest to the per-band median, by squared distance over all bands.

    Twice the median is an integer for an even count as well, so the distance is taken between
    doubled values. Days are at most eight, so this is a projection, not a join.
    """
    # A field of an array of structs is the array of that field.
    ranked = stack.selectExpr("*", *[f"sort_array(days.{b}) as sorted_{b}" for b in bands])

    def middle(band: str) -> str:
        low = f"sorted_{band}[(size(days) - 1) div 2]"
        high = f"sorted_{band}[size(days) div 2]"
        return f"cast({low} as bigint) + cast({high} as bigint) as twice_{band}"

    centred = ranked.selectExpr(*PATCH, *PERIOD_CELL, "days", *[middle(b) for b in bands])
    gaps = [f"(2 * cast(d.{b} as bigint) - twice_{b})" for b in bands]
    fields = [f"'score', {' + '.join(f'{g} * {g}' for g in gaps)}", "'slot', d.slot"]
    fields += [f"'{b}', d.{b}" for b in bands]
    best = f"array_min(transform(days, d -> named_struct({', '.join(fields)}))) as best"
    chosen = centred.selectExpr(*PATCH, *PERIOD_CELL, "size(days) as clear_days", best)
    return chosen.selectExpr(
        *PATCH,
        *PERIOD_CELL,
        "clear_days",
        "cast(date_add(period_start, best.slot) as string) as date_key",
        *[f"best.{b} as {b}" for b in bands],
    )


def optical_predictors(composite: DataFrame, bands: dict[str, str] | None = None) -> DataFrame:
    """Reflectances under their predictor names, then the three indices."""
    bands = OPTICAL_BANDS if bands is None else bands
    patch = PATCH if set(PATCH) <= set(composite.columns) else []
    named = composite.select(
        *patch, *PERIOD_CELL, *[reflectance(F.col(dn)).alias(name) for dn, name in bands.items()]
    )
    return with_indices(named)


def with_indices(frame: DataFrame) -> DataFrame:
    return frame.withColumns(
        {name: normalized_difference(F.col(a), F.col(b)) for name, (a, b) in INDEX_BANDS.items()}
    )
