"""Stations on grids: ET cells, observation grid, weather supports, geometry cells."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.geodesy import METRES_PER_DEGREE, haversine_m
from terraloom.operators.storage import written
from terraloom.sources.grids import Grid, pixel_id


def station_cells(stations: DataFrame, et_grid: Grid) -> DataFrame:
    """ET cell, pixel id and cell area of each station; stations in one cell keep their own rows."""
    placed = et_grid.project(stations, "longitude", "latitude", "__x", "__y")
    column, row = et_grid.index(F.col("__x"), F.col("__y"))
    placed = placed.withColumns({"cell_x": column, "cell_y": row}).drop("__x", "__y")
    return with_pixel_id(placed, et_grid.step_x, et_grid.step_y)


def with_pixel_id(cells: DataFrame, step_x: float, step_y: float) -> DataFrame:
    """Identifier, geometry key and area of the ET cell (`cell_x`, `cell_y`), equal-area grid."""
    identifier = pixel_id(F.col("cell_x"), F.col("cell_y"))
    return cells.withColumns(
        {
            "modis_pixel_id": identifier,
            "geom_id": identifier.cast("string"),
            "footprint_area_m2": F.lit(abs(step_x * step_y)),
        }
    )


def cell_of(stations: DataFrame, grid: Grid, x: str, y: str) -> DataFrame:
    """Add the station's own cell on `grid` as columns `x` and `y`."""
    placed = grid.project(stations, "longitude", "latitude", "__x", "__y")
    column, row = grid.index(F.col("__x"), F.col("__y"))
    return placed.withColumns({x: column, y: row}).drop("__x", "__y")


def cell_neighbourhood(cells: DataFrame, reach: int = 2) -> DataFrame:
    """The distinct cells within `reach` rows and columns of the given ones."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return (
        cells.select("cell_x", "cell_y")
        .distinct()
        .withColumn("__dx", F.explode(steps))
        .withColumn("__dy", F.explode(steps))
        .select(
            (F.col("cell_x") + F.col("__dx")).alias("cell_x"),
            (F.col("cell_y") + F.col("__dy")).alias("cell_y"),
        )
        .distinct()
    )


def observation_grid(sites: DataFrame, periods: DataFrame) -> DataFrame:
    """Every site in every period.

    The period list is one scalar value, at most one date per day of the window, that each site
    row unfolds in place: no cross join, no shuffle.
    """
    dates = periods.agg(F.sort_array(F.collect_set("period_start"))).scalar()
    listed = sites.withColumn("__periods", dates)
    return listed.withColumn("period_start", F.explode("__periods")).drop("__periods")


def first_valid_cells(hourly: DataFrame) -> DataFrame:
    """Cells with a temperature in the first hour of the table."""
    first = hourly.agg(F.min("hour")).scalar()
    valid = (F.col("hour") == first) & F.col("t2m").isNotNull()
    return hourly.filter(valid).select("cell_x", "cell_y").distinct()


def nearest_cells(
    stations: DataFrame, valid_cells: DataFrame, grid: Grid, radius_m: float
) -> DataFrame:
    """Nearest valid cell centre within `radius_m`; stations without one drop out.

    Each station lists the cells its radius can reach, keeps those really within it, and looks
    them up by an equi join. The list's length depends on the radius and the grid only.
    """
    rows = ceil(radius_m / (METRES_PER_DEGREE * abs(grid.step_y))) + 1
    reach_deg = radius_m / METRES_PER_DEGREE
    # Circumference of the parallel shrinks towards the poles; the far edge of the circle decides.
    narrowest = F.cos(
        F.radians(F.least(F.abs(F.col("latitude")) + F.lit(reach_deg), F.lit(89.9)))
    )
    around = round(360.0 / abs(grid.step_x))
    columns = F.least(
        F.ceil(F.lit(radius_m) / (F.lit(METRES_PER_DEGREE * abs(grid.step_x)) * narrowest)) + 1,
        F.lit(around // 2),
    )
    own_x, own_y = grid.index(F.col("longitude"), F.col("latitude"))
    candidates = (
        _unfolding(stations, "station_id")
        .select("station_id", "longitude", "latitude", own_x.alias("__ox"), own_y.alias("__oy"))
        .withColumn("__dx", F.explode(F.sequence(-columns, columns)))
        .withColumn("__dy", F.explode(F.sequence(F.lit(-rows), F.lit(rows))))
        .withColumns(
            {
                # A global grid closes on itself at the date line.
                "cell_x": F.pmod(F.col("__ox") + F.col("__dx"), F.lit(around)),
                "cell_y": F.col("__oy") + F.col("__dy"),
            }
        )
    )
    lon, lat = grid.centre(F.col("cell_x"), F.col("cell_y"))
    near = (
        candidates.withColumns({"__lon": lon, "__lat": lat})
        .withColumn(
            "__d", haversine_m(F.col("longitude"), F.col("latitude"), F.col("__lon"), F.col("__lat"))
        )
        .filter(F.col("__d") <= radius_m)
        .select("station_id", "cell_x", "cell_y", "__lon", "__lat", "__d")
    )
    found = near.join(valid_cells.select("cell_x", "cell_y"), ["cell_x", "cell_y"])
    best = F.min_by(
        F.struct("cell_x", "cell_y", "__lon", "__lat", "__d"), F.struct("__d", "cell_y", "cell_x")
    )
    return (
        found.groupBy("station_id")
        .agg(best.alias("b"))
        .select(
            "station_id",
            F.col("b.cell_x").alias("met_x"),
            F.col("b.cell_y").alias("met_y"),
            F.col("b.__lon").alias("era5_sampling_longitude"),
            F.col("b.__lat").alias("era5_sampling_latitude"),
            F.col("b.__d").alias("era5_sampling_distance_m"),
        )
    )


def unresolved_stations(stations: DataFrame, supports: DataFrame) -> DataFrame:
    """Stations without coordinates or without a support."""
    located = stations.filter(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    resolved = supports.join(located.select("station_id"), "station_id", "left_semi")
    return stations.join(resolved.select("station_id"), "station_id", "left_anti")


def require_supports(stations: DataFrame, supports: DataFrame) -> None:
    """Raise unless every station has a support; names at most a few of the failing ones."""
    if supports.isEmpty():
        raise ValueError("no station has a weather support cell")
    failing = unresolved_stations(stations, supports).select("station_id").head(5)
    if failing:
        names = ", ".join(str(r[0]) for r in failing)
        raise ValueError(f"stations without a valid weather cell in range: {names}")


def numbered(frame: DataFrame, order: list[str], number: str) -> DataFrame:
    """The rows in `order`, numbered from 1 in the column `number`.

    Range partitions number their own rows; a running total over the partition sizes, one row per
    partition, shifts them. The ordered rows are written once, because both steps must see the same
    partitions.
    """
    slot = F.monotonically_increasing_id()
    ordered = written(
        frame.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__slot", slot)
        .select(
            *frame.columns,
            F.shiftright("__slot", 33).alias("__part"),
            F.col("__slot").bitwiseAND(F.lit((1 << 33) - 1)).alias("__local"),
        ),
        "ordered",
    )
    sizes = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return ordered.join(offsets, "__part").select(
        *frame.columns, (F.col("__o") + F.col("__local") + 1).alias(number)
    )


def station_index(stations: DataFrame) -> DataFrame:
    """Distinct station ids in order, numbered from 1."""
    return numbered(stations.select("station_id").distinct(), ["station_id"], "station_index")


def _cells_between(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.least(low, high), F.greatest(low, high)))


def _overlap(centre: Column, half: float, index: Column, origin: float, step: float) -> Column:
    """Length shared by [centre - half, centre + half] and one cell of the axis."""
    edge = F.lit(origin) + index * F.lit(step)
    low, high = F.least(edge, edge + F.lit(step)), F.greatest(edge, edge + F.lit(step))
    shared = F.least(high, centre + F.lit(half)) - F.greatest(low, centre - F.lit(half))
    return F.greatest(shared, F.lit(0.0))


def local_cells(stations: DataFrame, grid: Grid, half_width: float) -> DataFrame:
    """Cells of the square box around each station, weighted by the overlapped share of the cell."""
    placed = grid.project(stations, "longitude", "latitude", "__x", "__y")
    x, y = F.col("__x"), F.col("__y")
    west, south = grid.index(x - half_width, y - half_width)
    east, north = grid.index(x + half_width, y + half_width)
    spread = placed.withColumn("cell_x", _cells_between(west, east)).withColumn(
        "cell_y", _cells_between(south, north)
    )
    shared = _overlap(x, half_width, F.col("cell_x"), grid.origin_x, grid.step_x) * _overlap(
        y, half_width, F.col("cell_y"), grid.origin_y, grid.step_y
    )
    weight = shared / F.lit(abs(grid.step_x * grid.step_y))
    return (
        spread.withColumn("weight", weight)
        .filter(F.col("weight") > 0)
        .select(
            F.col("station_id").alias("geom_id"),
            F.lit("local_60m").alias("scale"),
            "cell_x",
            "cell_y",
            "weight",
        )
    )


def _unfolding(frame: DataFrame, *keys: str) -> DataFrame:
    """Spread few small rows by key before each of them unfolds into many.

    Runtime merging goes by bytes and would put all of these rows into one task; a given number of
    partitions keeps them apart. Aggregations on the keys need no further shuffle.
    """
    partitions = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(partitions, *keys)


def _footprint_frames(et_cells: DataFrame, et_grid: Grid, grid: Grid) -> DataFrame:
    """Per ET cell: its four corners on the analysis grid and the cell range that covers them."""
    cells = et_cells.select(F.col("cell_x").alias("et_x"), F.col("cell_y").alias("et_y")).distinct()
    cells = _unfolding(cells, "et_x", "et_y")
    pairs = [(a, b) for a in (0, 1) for b in (0, 1)]
    corner = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    spread = cells.withColumn("__c", F.explode(corner)).select("et_x", "et_y", "__c.a", "__c.b")
    ex, ey = et_grid.at(F.col("et_x") + F.col("a"), F.col("et_y") + F.col("b"))
    spread = et_grid.unproject(spread.withColumns({"ex": ex, "ey": ey}), "ex", "ey", "lon", "lat")
    spread = grid.project(spread, "lon", "lat", "x", "y")
    column, row = grid.index(F.col("x"), F.col("y"))

    def corner_value(name: str, a: int, b: int) -> Column:
        here = (F.col("a") == a) & (F.col("b") == b)
        return F.max(F.when(here, F.col(name))).alias(f"{name}{a}{b}")

    return spread.groupBy("et_x", "et_y").agg(
        F.min(column).alias("west"),
        F.max(column).alias("east"),
        F.min(row).alias("south"),
        F.max(row).alias("north"),
        *[corner_value(name, a, b) for name in ("x", "y") for a, b in pairs],
    )


def footprint_cells(et_cells: DataFrame, et_grid: Grid, grid: Grid, samples: int) -> DataFrame:
    """Analysis cells of each ET cell, weighted by the share of sub-samples inside it.

    Seen on the analysis grid an ET cell is close to a parallelogram. A cell further from its edges
    than half a cell diagonal needs one sample inside and none outside; only the border cells are
    sampled `samples` x `samples` times. Each ET cell is treated once, however many stations it
    holds.
    """
    frames = _footprint_frames(et_cells, et_grid, grid)
    # One cell of margin: the projected edges are slightly curved.
    boxed = frames.withColumn(
        "cell_x", F.explode(F.sequence(F.col("west") - 1, F.col("east") + 1))
    ).withColumn("cell_y", F.explode(F.sequence(F.col("south") - 1, F.col("north") + 1)))

    px, py = grid.centre(F.col("cell_x"), F.col("cell_y"))
    dx, dy = px - F.col("x00"), py - F.col("y00")
    ax, ay = F.col("x10") - F.col("x00"), F.col("y10") - F.col("y00")
    bx, by = F.col("x01") - F.col("x00"), F.col("y01") - F.col("y00")
    area = ax * by - ay * bx
    u, v = (dx * by - dy * bx) / area, (ax * dy - ay * dx) / area
    # Distance to the nearest edge, negative outside.
    inset = F.least(
        (F.lit(0.5) - F.abs(u - 0.5)) * F.abs(area) / F.hypot(bx, by),
        (F.lit(0.5) - F.abs(v - 0.5)) * F.abs(area) / F.hypot(ax, ay),
    )
    # Half a cell diagonal, the departure from a parallelogram, and one unit for curved edges.
    bend = F.hypot(
        F.col("x11") - F.col("x10") - F.col("x01") + F.col("x00"),
        F.col("y11") - F.col("y10") - F.col("y01") + F.col("y00"),
    )
    reach = bend + (0.5 * (grid.step_x**2 + grid.step_y**2) ** 0.5 + 1.0)
    placed = boxed.select(
        "et_x", "et_y", "cell_x", "cell_y", inset.alias("inset"), reach.alias("reach")
    ).filter(F.col("inset") > -F.col("reach"))

    axis = F.array(*[F.lit((i + 0.5) / samples) for i in range(samples)])
    ticks = F.when(F.col("inset") > F.col("reach"), F.array(F.lit(0.5))).otherwise(axis)
    sampled = placed.withColumn("u", F.explode(ticks)).withColumn("v", F.explode(ticks))
    sx, sy = grid.at(F.col("cell_x") + F.col("u"), F.col("cell_y") + F.col("v"))
    sampled = sampled.select("et_x", "et_y", "cell_x", "cell_y", sx.alias("x"), sy.alias("y"))
    sampled = grid.unproject(sampled, "x", "y", "lon", "lat")
    sampled = et_grid.project(sampled, "lon", "lat", "ex", "ey")
    hx, hy = et_grid.index(F.col("ex"), F.col("ey"))
    hit = (hx == F.col("et_x")) & (hy == F.col("et_y"))
    votes = sampled.groupBy("et_x", "et_y", "cell_x", "cell_y").agg(
        F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("tries")
    )
    return votes.filter(F.col("hits") > 0).select(
        pixel_id(F.col("et_x"), F.col("et_y")).cast("string").alias("geom_id"),
        F.lit("footprint").alias("scale"),
        "cell_x",
        "cell_y",
        (F.col("hits") / F.col("tries")).alias("weight"),
    )
