"""Reductions of pixels over geometries, by way of the bridge table `geometry_cells`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.calendar import PERIOD_DAYS
from terraloom.schemas import PREDICTOR_SHIFTS

CELL = ["cell_x", "cell_y"]
ZONE = ["geom_id", "scale", "period_start"]


def footprint_cells_of(bridge: DataFrame) -> DataFrame:
    return bridge.filter(F.col("scale") == "footprint")


# A patch is 8 x 8 cells: one bit each of one 64-bit number, so a union of masks is a bitwise or.
PATCH_SHIFT = 3
PATCH = ["patch_x", "patch_y"]


def with_squares(frame: DataFrame) -> DataFrame:
    """Add the cell's patch; rows that carry it keep it, for they may be dealt by it."""
    if set(PATCH) <= set(frame.columns):
        return frame
    return frame.withColumns({p: F.shiftright(c, PATCH_SHIFT) for p, c in zip(PATCH, CELL, strict=True)})


def with_patch(frame: DataFrame) -> DataFrame:
    """Add the cell's patch and its bit there."""
    inner = (1 << PATCH_SHIFT) - 1
    low = [F.col(c).bitwiseAND(F.lit(inner)) for c in ("cell_x", "cell_y")]
    place = (low[1] * (1 << PATCH_SHIFT) + low[0]).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
    return with_squares(frame).withColumn("bit", bit)


def by_patch(frame: DataFrame) -> DataFrame:
    """Rows of pixels dealt out by patch, with the patch's columns.

    What follows groups by cell or sums over zones; a zone's cells share a few patches, so both find
    their rows in one task. Rows that carry the patch have been dealt.
    """
    if set(PATCH) <= set(frame.columns):
        return frame
    return with_squares(frame).repartition(*PATCH)


def _or(condition: Column | None = None) -> Column:
    bit = F.col("bit") if condition is None else F.when(condition, F.col("bit"))
    return F.coalesce(F.bit_or(bit), F.lit(0).cast("bigint"))


def _or_of(bits: str, condition: Column) -> Column:
    return F.coalesce(F.bit_or(F.when(condition, F.col(bits))), F.lit(0).cast("bigint"))


def _held(bits: Column, others: Column) -> Column:
    return bits.bitwiseAND(others)


def bridge_patches(bridge: DataFrame) -> DataFrame:
    """Per geometry and patch: the cells by weight (`weight`, `bits`), those that count at all, and
    whether the geometry has no other patch (`alone`).
    """
    alike = with_patch(bridge).groupBy("geom_id", *PATCH, "weight").agg(_or().alias("bits"))
    patches = alike.groupBy("geom_id", *PATCH).agg(
        F.collect_list(F.struct("weight", "bits")).alias("cells"),
        F.bit_or(F.when(F.col("weight") > 0, F.col("bits"))).alias("touch"),
    )
    whole = patches.groupBy("geom_id").agg(
        F.collect_list(F.struct(*PATCH, "cells", "touch")).alias("patches")
    )
    return whole.select("geom_id", (F.size("patches") == 1).alias("alone"), F.inline("patches"))


def zone_summary(
    rows: DataFrame, masks: list[Column], bridge: DataFrame, once: str | None = None
) -> DataFrame:
    """Coverage and scene dates of each geometry and period from one pass over dated pixel keys.

    A cell is valid in a period if every mask holds for some pixel of it. Pixels become bits of
    patches in the tasks that read them, so what is shuffled is a row per scene and patch, once by
    patch and, as a row per geometry, once by geometry; a join on geometries finds them dealt so.
    Coverage is a population count against the geometry's own bits, weight by weight. Absent pixels
    count as invalid, as the area comes from the bridge alone. The days of a period are eight bits.
    Names of scenes travel only if `products_total` is read, and to the geometries only where one
    has several patches, which may share scenes. A patch sees a scene or two a day and a period has
    eight days, so its scene list is bounded. With `once`, the name of the table, a scene that holds
    a cell twice is an error. Returns geom_id, period_start, share, dates_total, dates,
    products_total; a geometry that no pixel touches in a period has no row.
    """
    names = [f"mask{k}" for k in range(len(masks))]
    scene = with_patch(rows).groupBy("period_start", *PATCH, "dd", "scene_id")
    seen = _or()
    if once is not None:
        pixels = F.count(F.lit(1))
        where = [F.col(c).cast("string") for c in ("scene_id", *PATCH)]
        message = F.concat_ws(
            " ", F.lit(f"{once} holds"), pixels.cast("string"), F.lit("rows of"),
            F.bit_count(seen).cast("string"), F.lit("cells in scene, patch_x, patch_y"), *where,
        )
        seen = F.when(pixels == F.bit_count(seen), seen).otherwise(F.raise_error(message))
    per_scene = scene.agg(
        seen.alias("seen"), *[_or(mask).alias(name) for mask, name in zip(masks, names, strict=True)]
    )
    slot = F.datediff(F.col("dd"), F.col("period_start"))
    slots = [f"seen{i}" for i in range(PERIOD_DAYS)]
    per_patch = (
        per_scene.repartition(*PATCH)
        .groupBy(*PATCH, "period_start")
        .agg(
            *[F.bit_or(name).alias(name) for name in names],
            *[_or_of("seen", slot == i).alias(name) for i, name in enumerate(slots)],
            F.collect_list(F.struct("dd", "scene_id", "seen")).alias("scenes"),
        )
    )
    valid = reduce(_held, [F.col(name) for name in names])
    per_patch = per_patch.select("period_start", *PATCH, valid.alias("valid"), *slots, "scenes")

    def counted(total: Column, cells: Column) -> Column:
        return total + cells["weight"] * F.bit_count(_held(F.col("valid"), cells["bits"]))

    touched = F.transform(
        F.filter("scenes", lambda s: _held(s["seen"], F.col("touch")) != 0),
        lambda s: F.struct(s["dd"].alias("dd"), s["scene_id"].alias("scene_id")),
    )
    met = [
        F.when(_held(F.col(name), F.col("touch")) != 0, 1 << i).otherwise(0)
        for i, name in enumerate(slots)
    ]
    distinct = F.size(F.array_distinct(F.flatten(F.collect_list("scenes"))))
    area = bridge.groupBy("geom_id").agg(F.sum("weight").alias("area"))
    per_zone = (
        per_patch.join(bridge_patches(bridge), PATCH)
        .select(
            "geom_id",
            "period_start",
            F.aggregate("cells", F.lit(0.0), counted).alias("covered"),
            reduce(Column.bitwiseOR, met).alias("days"),
            F.when(F.col("alone"), F.size(touched)).alias("products"),
            F.when(~F.col("alone"), touched).alias("scenes"),
        )
        .filter(F.col("days") != 0)
        .repartition("geom_id")
        .groupBy("geom_id", "period_start")
        .agg(
            F.sum("covered").alias("covered"),
            F.bit_or("days").alias("days"),
            F.coalesce(F.first("products"), distinct).alias("products_total"),
        )
        .join(area, "geom_id")
    )
    dates = [
        F.when(F.col("days").bitwiseAND(F.lit(1 << i)) != 0, F.date_add("period_start", i).cast("string"))
        for i in range(PERIOD_DAYS)
    ]
    return per_zone.select(
        "geom_id",
        "period_start",
        (F.col("covered") / F.col("area")).alias("share"),
        F.bit_count("days").alias("dates_total"),
        F.concat_ws(";", *dates).alias("dates"),
        "products_total",
    )


# Moments: per band the weight `w`, the weighted sums of differences from a fixed value `s` and of
# their squares `q`, and the range. All of them merge by adding, or by the smaller and larger value.
_MOMENTS = {"w": F.sum, "s": F.sum, "q": F.sum, "low": F.min, "high": F.max}


def band_moments(
    placed: DataFrame, keys: list[str], bands: list[str], shifts: dict[str, float] | None = None
) -> DataFrame:
    """Mergeable moments of every band per `keys`: one aggregation, combined before its shuffle.

    A NULL value adds nothing. Differences are taken from the band's shift, a value in the middle of
    what it can hold (`schemas.PREDICTOR_SHIFTS`, 0 for other bands): the deviation of values x then
    keeps about 16 - 2 log10(|x - shift| / deviation) digits.
    """
    shifts = PREDICTOR_SHIFTS if shifts is None else shifts
    parts = []
    for band in bands:
        value = F.col(band)
        apart = value - F.lit(float(shifts.get(band, 0.0)))
        weighted = F.col("weight") * apart
        terms = {
            "w": F.when(value.isNotNull(), F.col("weight")),
            "s": weighted,
            "q": weighted * apart,
            "low": value,
            "high": value,
        }
        parts += [merge(terms[m]).alias(f"{band}_{m}") for m, merge in _MOMENTS.items()]
    return placed.groupBy(*keys).agg(*parts)


def merged_moments(moments: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Moments of coarser groups, from those of finer ones: parts of a zone, periods, batches."""
    parts = [
        merge(f"{band}_{m}").alias(f"{band}_{m}") for band in bands for m, merge in _MOMENTS.items()
    ]
    return moments.groupBy(*keys).agg(*parts)


def moment_statistics(
    moments: DataFrame, keys: list[str], bands: list[str], shifts: dict[str, float] | None = None
) -> DataFrame:
    """Weighted mean and population standard deviation of every band; NULL where nothing was summed.

    Equal values have exactly their own mean and no deviation.
    """
    shifts = PREDICTOR_SHIFTS if shifts is None else shifts
    found = []
    for band in bands:
        w, s, q, low, high = (F.col(f"{band}_{m}") for m in _MOMENTS)
        mean, square = F.try_divide(s, w), F.try_divide(q, w)
        variance = square - mean * mean
        # Rounding may leave less than nothing; NULL stays NULL.
        spread = F.sqrt(F.when(variance < 0, F.lit(0.0)).otherwise(variance))
        shifted = mean + F.lit(float(shifts.get(band, 0.0)))
        found += [
            F.when(low == high, low.cast("double")).otherwise(shifted).alias(f"{band}_mean"),
            F.when(low == high, F.lit(0.0)).otherwise(spread).alias(f"{band}_stdDev"),
        ]
    return moments.select(*keys, *found)


def zonal_statistics(
    predictors: DataFrame,
    bridge: DataFrame,
    bands: list[str],
    shifts: dict[str, float] | None = None,
) -> DataFrame:
    """Weighted mean and population standard deviation per geometry, scale and period.

    Every task sums the pixels that it holds; one row of moments per zone and task is shuffled. Where
    predictors carry the patch by which they were dealt (`by_patch`), a zone is whole in a few tasks,
    and a bridge too large to broadcast meets them by patch without another shuffle of them.
    """
    keys = CELL
    if set(PATCH) <= set(predictors.columns):
        bridge, keys = by_patch(bridge), [*PATCH, *CELL]
    placed = predictors.join(bridge, keys).select(*ZONE, "weight", *bands)
    return moment_statistics(band_moments(placed, ZONE, bands, shifts), ZONE, bands, shifts)


@dataclass(frozen=True)
class Source:
    """Pixels dealt by patch (`by_patch`), how they become one value of each band per period and cell,
    and the bands.
    """

    pixels: DataFrame
    composite: Callable[[DataFrame], DataFrame]
    bands: list[str]


def closed_patches(bridge: DataFrame) -> DataFrame:
    """The bridge dealt by patch, with `closed`: no geometry of the patch has cells in another one."""
    own, patch = Window.partitionBy("geom_id", "scale"), Window.partitionBy(*PATCH)
    single = [F.min(p).over(own) == F.max(p).over(own) for p in PATCH]
    placed = with_squares(bridge).withColumn("single", single[0] & single[1])
    return placed.withColumn("closed", F.min("single").over(patch)).drop("single")


def statistics_of(sources: list[Source], bridge: DataFrame) -> DataFrame:
    """`zonal_statistics` of several sources side by side, without a shuffle of most zones.

    Moments of a zone are as wide as many pixels, so only those of geometries that share no closed
    patch are shuffled: the zones of a closed patch are whole, and their sources meet, where its pixels
    were dealt. A patch goes one of both ways with all of its pixels, so no cell is composed twice,
    and both read the same shuffle. Lists of patches and cells are hashed in their tasks, so that
    pixels need no sort to meet them.
    """
    cells = closed_patches(bridge)

    def moments(source: Source, part: DataFrame, keys: list[str]) -> DataFrame:
        patches = part.select(*PATCH).distinct().hint("shuffle_hash")
        predictors = source.composite(source.pixels.join(patches, PATCH))
        placed = predictors.join(part.hint("shuffle_hash"), [*PATCH, *CELL])
        return band_moments(placed.select(*PATCH, *ZONE, "weight", *source.bands), keys, source.bands)

    def side_by_side(part: DataFrame, keys: list[str]) -> DataFrame:
        found = [moment_statistics(moments(s, part, keys), keys, s.bands) for s in sources]
        return reduce(lambda left, right: left.join(right, keys, "full"), found)

    whole = side_by_side(cells.filter("closed"), [*PATCH, *ZONE]).drop(*PATCH)
    return whole.unionByName(side_by_side(cells.filter("not closed"), ZONE))
