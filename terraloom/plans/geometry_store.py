"""Resolved geometries kept between runs: each is computed once for a definition of its grids.

Footprints are sampled, boxes overlapped and weather supports searched for entries that the store
does not hold yet; an anti join finds them. What was computed is a run of its own, and a list of
known entries names it last, so a run that died is never read and its entries are computed anew.
A changed definition (grid, sample count, radius, first hour of weather) has entries of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import astuple, dataclass
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.operators.stations import footprint_cells, local_cells, nearest_cells
from terraloom.operators.storage import written
from terraloom.schemas import GEOMETRY_CELLS, columns
from terraloom.sources.grids import Grid, pixel_id

_KNOWN = columns("definition string, entry string, run string")
SUPPORTS = columns(
    "station_id string, met_x bigint, met_y bigint, era5_sampling_longitude double, "
    "era5_sampling_latitude double, era5_sampling_distance_m double"
)


def definition_of(*parts: object) -> str:
    """A short name for everything that a computation depends on besides its entries."""
    listed = [astuple(p) if isinstance(p, Grid) else p for p in parts]
    return hashlib.sha256(repr(listed).encode()).hexdigest()[:32]


def _at(*names: str) -> Column:
    """An entry key from columns; doubles are spelled in full, so a moved station is a new entry."""
    return F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])


@dataclass(frozen=True)
class GeometryStore:
    """Tables of geometries below `path`. One writer at a time adds to them."""

    spark: SparkSession
    path: str

    def footprints(self, et_cells: DataFrame, et_grid: Grid, grid: Grid, samples: int) -> DataFrame:
        """Analysis cells of the footprints of ET cells (`operators.stations.footprint_cells`)."""
        wanted = et_cells.select("cell_x", "cell_y").distinct()
        wanted = wanted.withColumn("entry", pixel_id(F.col("cell_x"), F.col("cell_y")).cast("string"))

        def compute(new: DataFrame) -> DataFrame:
            cells = footprint_cells(new, et_grid, grid, samples)
            return cells.withColumn("entry", F.col("geom_id"))

        name = definition_of(et_grid, grid, samples)
        return self._resolved("footprints", name, wanted, GEOMETRY_CELLS, compute)

    def boxes(self, stations: DataFrame, grid: Grid, half_width: float) -> DataFrame:
        """Analysis cells of the stations' boxes (`operators.stations.local_cells`)."""

        def compute(new: DataFrame) -> DataFrame:
            entries = new.select(F.col("station_id").alias("geom_id"), "entry")
            return local_cells(new, grid, half_width).join(entries, "geom_id")

        name = definition_of(grid, half_width)
        return self._resolved("boxes", name, _placed(stations), GEOMETRY_CELLS, compute)

    def supports(
        self, stations: DataFrame, valid_cells: DataFrame, grid: Grid, radius_m: float, hour: object
    ) -> DataFrame:
        """Weather cells of the stations (`operators.stations.nearest_cells`); a station without one
        is searched again in the next run. `hour` is the one that `valid_cells` were valid in.
        """

        def compute(new: DataFrame) -> DataFrame:
            found = nearest_cells(new, valid_cells, grid, radius_m)
            return found.join(new.select("station_id", "entry"), "station_id")

        name = definition_of(grid, radius_m, str(hour))
        return self._resolved("supports", name, _placed(stations), SUPPORTS, compute)

    def _resolved(
        self,
        kind: str,
        definition: str,
        wanted: DataFrame,
        schema: T.StructType,
        compute: Callable[[DataFrame], DataFrame],
    ) -> DataFrame:
        """The rows of all wanted entries, after computing those that are not stored."""
        folder = f"{self.path}/{kind}"
        new = written(wanted.join(self._known(folder, definition), "entry", "left_anti"), "new-entries")
        if not new.isEmpty():
            run = uuid4().hex
            names = {"definition": F.lit(definition), "run": F.lit(run)}
            rows = compute(new).select(*schema.names, "entry").withColumns(names)
            rows.write.mode("append").partitionBy("definition", "run").parquet(f"{folder}/rows")
            # Only what has rows is known: an entry that gave none is tried again.
            given = self._rows(folder, definition, schema).filter(F.col("run") == run)
            known = given.select("entry").distinct().withColumns(names)
            known.select(*_KNOWN.names).write.mode("append").parquet(f"{folder}/known")
        stored = self._rows(folder, definition, schema)
        named = self._known(folder, definition).join(wanted.select("entry"), "entry", "left_semi")
        return stored.join(named, ["entry", "run"], "left_semi").select(*schema.names)

    def _known(self, folder: str, definition: str) -> DataFrame:
        """Stored entries with the run that holds them; should two hold one, a single run is named."""
        listed = self._stored(f"{folder}/known", _KNOWN).filter(F.col("definition") == definition)
        return listed.groupBy("entry").agg(F.max("run").alias("run"))

    def _rows(self, folder: str, definition: str, schema: T.StructType) -> DataFrame:
        keys = columns("entry string, definition string, run string")
        rows = self._stored(f"{folder}/rows", T.StructType([*schema.fields, *keys.fields]))
        return rows.filter(F.col("definition") == definition)

    def _stored(self, path: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)


def _placed(stations: DataFrame) -> DataFrame:
    placed = stations.select("station_id", "longitude", "latitude").distinct()
    return placed.withColumn("entry", _at("station_id", "longitude", "latitude"))
