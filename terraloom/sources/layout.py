"""How large pixel tables are stored so that a run opens only the files that it needs.

Folders by month and tile, rows inside by block. A tile is a square of blocks, coarse enough that its
month makes files of a useful size. The window then prunes months (`in_window`), and the wanted
geometries prune tiles (`operators.bounds`), both before a file is opened. Tables without these
columns are read as before.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.calendar import half_open
from terraloom.operators.bounds import BLOCK, TILE, with_block, with_tile
from terraloom.operators.optical import SCENE_CELL
from terraloom.operators.zonal import PATCH, with_squares

MONTH = "month"


def month_of(instant: Column) -> Column:
    """The month as one number that ascends with time, 202103 for March 2021."""
    return F.year(instant) * 100 + F.month(instant)


def write_pixels(pixels: DataFrame, path: str, instant: str = "ts") -> None:
    """Store a pixel table by month and tile. The rows of a folder are spread over as many files as
    their size asks for, so a hot tile is no single task.
    """
    laid_out = with_tile(pixels).withColumn(MONTH, month_of(F.col(instant)))
    keys = [MONTH, *TILE]
    ordered = with_block(laid_out.hint("rebalance", *keys)).sortWithinPartitions(*keys, *BLOCK, instant)
    ordered.drop(*BLOCK).write.partitionBy(*keys).parquet(path)


def save_bucketed(pixels: DataFrame, table: str, buckets: int, instant: str = "ts") -> None:
    """Save a pixel table in the catalog, by month and in buckets of scene and cell, sorted.

    Optical and cloud pixels saved with equal buckets join scene by scene without a shuffle. For runs
    that read most places; `write_pixels` prunes places instead.
    """
    ordered = pixels.withColumn(MONTH, month_of(F.col(instant))).repartition(buckets, *SCENE_CELL)
    writer = ordered.write.partitionBy(MONTH).bucketBy(buckets, *SCENE_CELL).sortBy(*SCENE_CELL)
    writer.saveAsTable(table)


def save_by_patch(pixels: DataFrame, table: str, buckets: int, instant: str = "ts") -> None:
    """Save a pixel table in the catalog, by month and in buckets of patches.

    Optical and cloud pixels saved so with equal buckets are linked, composed and summed over the zones
    of closed patches without a shuffle (`session.SETTINGS` let them). For runs of statistics.
    """
    laid_out = with_squares(pixels).withColumn(MONTH, month_of(F.col(instant)))
    writer = laid_out.repartition(buckets, *PATCH).write.partitionBy(MONTH)
    writer.bucketBy(buckets, *PATCH).sortBy(*PATCH).saveAsTable(table)


def in_window(frame: DataFrame, instant: str, start: date, end: date) -> DataFrame:
    """Rows with `instant` in [start, end); a table stored by month is pruned to the months of it."""
    rows = frame.filter(half_open(F.col(instant), start, end))
    if MONTH not in frame.columns:
        return rows
    last = end - timedelta(days=1)
    first_month, last_month = (d.year * 100 + d.month for d in (start, last))
    return rows.filter(F.col(MONTH).between(first_month, last_month))


def layout_columns(frame: DataFrame) -> list[str]:
    """The place columns of a stored table; a scan keeps them for the bounds to prune by, and patches
    for what follows to find its rows dealt.
    """
    return [c for c in (*TILE, *BLOCK, *PATCH) if c in frame.columns]
