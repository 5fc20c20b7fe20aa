"""Spatial restriction of pixel tables to the cells that some geometry touches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.operators.storage import written

# A block is 32 x 32 cells. A block list is far smaller than the cell list it stands for.
BLOCK_SHIFT = 5
BLOCK = ["block_x", "block_y"]
# A tile is 16 x 16 blocks: a folder of a stored table.
TILE_SHIFT = BLOCK_SHIFT + 4
TILE = ["tile_x", "tile_y"]


@dataclass(frozen=True)
class Blocks:
    """Wanted blocks of one grid."""

    blocks: DataFrame

    @cached_property
    def tiles(self) -> DataFrame:
        """The tiles of the blocks, written once: a list that small is known to be small, and so
        the planner turns it into a filter on a stored table's folders. The filter on the count
        keeps every row; without one the planner takes a list for the whole table.
        """
        shift = TILE_SHIFT - BLOCK_SHIFT
        tile = [F.shiftright(b, shift).alias(t) for b, t in zip(BLOCK, TILE, strict=True)]
        counted = self.blocks.groupBy(*tile).agg(F.count(F.lit(1)).alias("blocks"))
        return written(counted, "tiles").filter("blocks > 0").select(*TILE)

    def near(self, pixels: DataFrame) -> DataFrame:
        """Rows of `pixels` in a wanted block, without the columns of the layout.

        Tables stored by tile, or by block, are pruned by these joins. They have no hint: the lists'
        measured sizes decide how they run.
        """
        if set(TILE) <= set(pixels.columns):
            pixels = pixels.join(self.tiles, TILE, "left_semi").drop(*TILE)
        placed = pixels if set(BLOCK) <= set(pixels.columns) else with_block(pixels)
        return placed.join(self.blocks, BLOCK, "left_semi").drop(*BLOCK)


@dataclass(frozen=True)
class Bounds(Blocks):
    """The wanted cells and their blocks."""

    cells: DataFrame

    def restrict(self, pixels: DataFrame) -> DataFrame:
        """Rows of `pixels` on a wanted cell: by blocks first, then exactly."""
        return self.near(pixels).join(self.cells, ["cell_x", "cell_y"], "left_semi")


def _squares(names: list[str], shift: int) -> dict[str, Column]:
    return {n: F.shiftright(c, shift) for n, c in zip(names, ("cell_x", "cell_y"), strict=True)}


def with_block(frame: DataFrame) -> DataFrame:
    return frame.withColumns(_squares(BLOCK, BLOCK_SHIFT))


def with_tile(frame: DataFrame) -> DataFrame:
    return frame.withColumns(_squares(TILE, TILE_SHIFT))


def bounds_of(cells: DataFrame) -> Bounds:
    wanted = cells.select("cell_x", "cell_y").distinct()
    return Bounds(with_block(wanted).select(*BLOCK).distinct(), wanted)
