"""Regular grids: one row of the `grids` table describes how coordinates become cell indices."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.geodesy import (
    sinusoidal_forward,
    sinusoidal_inverse,
    with_utm_forward,
    with_utm_inverse,
)

# Offset and stride of the ET pixel identifier.
PIXEL_ID_OFFSET = 1_000_000
PIXEL_ID_STRIDE = 10_000_000


@dataclass(frozen=True)
class Grid:
    """`kind` is `latlon`, `sinusoidal`, or `utm` with zone and hemisphere (`utm18n`)."""

    grid_id: str
    kind: str
    origin_x: float
    origin_y: float
    step_x: float
    step_y: float
    scale_m: float

    def index(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Cell that holds the projected point (x, y)."""
        column = F.floor((x - F.lit(self.origin_x)) / F.lit(self.step_x)).cast("bigint")
        row = F.floor((y - F.lit(self.origin_y)) / F.lit(self.step_y)).cast("bigint")
        return column, row

    def at(self, column: Column, row: Column) -> tuple[Column, Column]:
        """Projected coordinates of a (possibly fractional) cell position."""
        return (
            F.lit(self.origin_x) + column * F.lit(self.step_x),
            F.lit(self.origin_y) + row * F.lit(self.step_y),
        )

    def centre(self, column: Column, row: Column) -> tuple[Column, Column]:
        return self.at(column + F.lit(0.5), row + F.lit(0.5))

    def project(self, frame: DataFrame, lon: str, lat: str, x: str, y: str) -> DataFrame:
        """Add the grid coordinates of a geographic point."""
        if self.kind == "latlon":
            return frame.withColumns({x: F.col(lon), y: F.col(lat)})
        if self.kind == "sinusoidal":
            east, north = sinusoidal_forward(F.col(lon), F.col(lat))
            return frame.withColumns({x: east, y: north})
        zone, south = self._utm()
        return with_utm_forward(frame, lon, lat, x, y, zone, south)

    def unproject(self, frame: DataFrame, x: str, y: str, lon: str, lat: str) -> DataFrame:
        """Add the longitude and latitude of a point given in grid coordinates."""
        if self.kind == "latlon":
            return frame.withColumns({lon: F.col(x), lat: F.col(y)})
        if self.kind == "sinusoidal":
            east, north = sinusoidal_inverse(F.col(x), F.col(y))
            return frame.withColumns({lon: east, lat: north})
        zone, south = self._utm()
        return with_utm_inverse(frame, x, y, lon, lat, zone, south)

    def _utm(self) -> tuple[int, bool]:
        match = re.fullmatch(r"utm(\d{1,2})([ns])", self.kind)
        if match is None:
            raise ValueError(f"unknown grid kind {self.kind!r}")
        return int(match[1]), match[2] == "s"


def read_grid(grids: DataFrame, grid_id: str) -> Grid:
    """The one grid of that id; at most two rows reach the driver."""
    rows = grids.filter(F.col("grid_id") == grid_id).head(2)
    if len(rows) != 1:
        raise ValueError(f"grid {grid_id!r} must have exactly one row")
    return Grid(**rows[0].asDict())


def pixel_id(column: Column, row: Column) -> Column:
    return (column + F.lit(PIXEL_ID_OFFSET)) * F.lit(PIXEL_ID_STRIDE).cast("bigint") + (
        row + F.lit(PIXEL_ID_OFFSET)
    )
