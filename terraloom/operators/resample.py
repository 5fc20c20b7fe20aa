"""Bilinear resampling between two grids of one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.operators.bounds import BLOCK_SHIFT, Blocks
from terraloom.sources.grids import Grid


def _targets(index: Column, origin: float, step: float, to_origin: float, to_step: float) -> Column:
    """Target indices whose centres lie within one source step of a source centre."""
    centre = F.lit(origin) + (index + F.lit(0.5)) * F.lit(step)
    reach = abs(step)
    a = (centre - F.lit(reach) - F.lit(to_origin)) / F.lit(to_step) - F.lit(0.5)
    b = (centre + F.lit(reach) - F.lit(to_origin)) / F.lit(to_step) - F.lit(0.5)
    return F.sequence(
        F.ceil(F.least(a, b)).cast("bigint"), F.floor(F.greatest(a, b)).cast("bigint")
    )


def _closeness(
    index: Column, target: Column, origin: float, step: float, to_origin: float, to_step: float
) -> Column:
    centre = F.lit(origin) + (index + F.lit(0.5)) * F.lit(step)
    to_centre = F.lit(to_origin) + (target + F.lit(0.5)) * F.lit(to_step)
    return F.lit(1.0) - F.abs(to_centre - centre) / F.lit(abs(step))


def _reached(block: str, origin: float, step: float, to_origin: float, to_step: float) -> Column:
    """Source blocks along one axis that hold the neighbours of a target block's cells."""
    size = 1 << BLOCK_SHIFT
    edges = [F.lit(to_origin) + (F.col(block) + n) * F.lit(to_step * size) for n in (0, 1)]
    low, high = F.least(*edges) - F.lit(abs(step)), F.greatest(*edges) + F.lit(abs(step))
    ends = [
        F.shiftright(F.floor((edge - F.lit(origin)) / F.lit(step)).cast("bigint"), BLOCK_SHIFT)
        for edge in (low, high)
    ]
    return F.explode(F.sequence(F.least(*ends), F.greatest(*ends)))


def source_blocks(wanted: Blocks, source: Grid, target: Grid) -> Blocks:
    """Blocks of the source grid whose pixels some cell of a wanted target block draws on.

    A target cell draws on source centres within one source step, so the block's extent is widened
    by that much. The list is a few blocks per wanted block.
    """
    x = (source.origin_x, source.step_x, target.origin_x, target.step_x)
    y = (source.origin_y, source.step_y, target.origin_y, target.step_y)
    spread = wanted.blocks.withColumn("__bx", _reached("block_x", *x)).withColumn(
        "__by", _reached("block_y", *y)
    )
    return Blocks(
        spread.select(F.col("__bx").alias("block_x"), F.col("__by").alias("block_y")).distinct()
    )


def resample_bilinear(
    pixels: DataFrame, bands: list[str], source: Grid, target: Grid, keys: list[str]
) -> DataFrame:
    """Weighted blend of the surrounding source pixels; NULL-free only where all of them are valid.

    Every valid pixel sends its share to the few targets near it, so one map-side combined
    aggregation replaces the neighbour join. Weights of a complete neighbourhood sum to 1; a
    smaller sum means a masked or absent neighbour, and the band becomes NULL there.
    """
    x = ("cell_x", source.origin_x, source.step_x, target.origin_x, target.step_x)
    y = ("cell_y", source.origin_y, source.step_y, target.origin_y, target.step_y)
    sent = pixels.withColumn("__tx", F.explode(_targets(F.col(x[0]), *x[1:]))).withColumn(
        "__ty", F.explode(_targets(F.col(y[0]), *y[1:]))
    )
    weight = _closeness(F.col(x[0]), F.col("__tx"), *x[1:]) * _closeness(
        F.col(y[0]), F.col("__ty"), *y[1:]
    )
    sent = sent.withColumn("__w", weight).filter(F.col("__w") > 0)
    sums = []
    for band in bands:
        present = F.when(F.col(band).isNotNull(), F.col("__w"))
        complete = F.sum(present) > F.lit(1 - 1e-9)
        sums.append(F.when(complete, F.sum(F.col("__w") * F.col(band)) / F.sum(present)).alias(band))
    blended = sent.groupBy(*keys, "__tx", "__ty").agg(*sums)
    return blended.withColumnsRenamed({"__tx": "cell_x", "__ty": "cell_y"})
