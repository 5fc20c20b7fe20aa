"""The logical input tables, derived from the driver tables.

Suppliers act as stations. A station owns four analysis cells (`cell_x` = station, `cell_y` = 0..3)
and one ET cell. Line items act as optical scenes, orders as radar scenes and rain, events as
hourly weather. `FIXTURES.md` gives the reasons; `oracle.py` spells the same tables in SQL.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.config import AnalysisConfig
from terraloom.operators.stations import with_pixel_id
from terraloom.operators.zonal import PATCH, PATCH_SHIFT
from terraloom.plans.inputs import Inputs, Places
from terraloom.schemas import OPTICAL_BANDS
from terraloom.session import CO_PARTITION, SETTINGS
from terraloom.sources.grids import Grid

CONFIG = AnalysisConfig(start=date(1995, 2, 1), end=date(2001, 8, 1))

# Sizes of the stand-in grids.
ET_STEP_M = 463.312716528
ERA5_SUPPORT_M = 11131.949079327358
CHIRPS_SUPPORT_M = 5565.974539663679
ET_GRID = Grid("et", "sinusoidal", -20015109.354, 10007554.677, ET_STEP_M, -ET_STEP_M, ET_STEP_M)
ANALYSIS_GRID = Grid("analysis", "utm18n", 0.0, 0.0, 20.0, 20.0, 20.0)
MET_GRID = Grid("met", "latlon", -180.0, 90.0, 0.1, -0.1, ERA5_SUPPORT_M)

# Stored value of each band: (price factor, cell factor, quantity factor), modulo 10,000.
BAND_FACTORS = {
    "b2": (3, 0, 0),
    "b3": (7, 911, 0),
    "b4": (1, 0, 97),
    "b5": (11, 577, 0),
    "b6": (13, 0, 31),
    "b7": (17, 353, 7),
    "b8a": (19, 733, 0),
    "b11": (23, 0, 59),
    "b12": (29, 199, 3),
}
FOOTPRINT_WEIGHTS = (1.0, 1.0, 0.5, 0.25)
LOCAL_WEIGHTS = (1.0, 0.25)
# Events cover 30 days of 2024; twelve shifted copies cover 1999.
EVENT_COPIES, EVENT_DAYS, EVENT_SHIFT = 12, 30, -9131
# Rows of a driver table that one task unfolds into pixels.
ROWS_PER_TASK = 125_000


def once(build):
    """Keep what `build` returns per application and folder: plans and file lists, no rows."""
    kept = {}

    @wraps(build)
    def lookup(spark: SparkSession, sf_dir: str, *args):
        key = (spark.sparkContext.applicationId, sf_dir, *args)
        if key not in kept:
            kept[key] = build(spark, sf_dir, *args)
        return kept[key]

    return lookup


@once
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standard_period(day: Column) -> Column:
    """Start of the 8-day composite that holds `day`."""
    year_start = F.make_date(F.year(day), F.lit(1), F.lit(1))
    return F.date_add(year_start, (F.floor((F.dayofyear(day) - 1) / 8) * 8).cast("int"))


@once
def _tasks(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks that unfold a table: they follow its number of rows, which the files' footers give."""
    rows = table(spark, sf_dir, name).count()
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def _dealt(
    spark: SparkSession, sf_dir: str, name: str, scene: Column, place: Column | None = None
) -> DataFrame:
    """A table whose rows unfold into pixels, dealt out by `scene_id` as a bucketed pixel table is.

    A file may be one split, so rows have to be dealt anyway. By scene, joins and aggregations that
    have it among their keys need no shuffle of the unfolded rows. With `place`, the `cell_x` of a
    row's pixels, it is dealt by patch instead, into no fewer tasks than other shuffles by patch make:
    those then follow it.
    """
    # A join takes rows dealt by a part of its keys only if the session allows it.
    spark.conf.set(CO_PARTITION, SETTINGS[CO_PARTITION])
    keyed = table(spark, sf_dir, name).withColumn("scene_id", scene)
    tasks = _tasks(spark, sf_dir, name)
    if place is None:
        return keyed.repartition(tasks, "scene_id")
    # Rows reach from `cell_y` 0 to 3. A plain 0 would be folded into the joins and leave their keys.
    squares = [F.shiftright(c, PATCH_SHIFT) for c in (place, place * 0)]
    placed = keyed.withColumns(dict(zip(PATCH, squares, strict=True)))
    return placed.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *PATCH)


def _pixels(frame: DataFrame) -> DataFrame:
    """Four pixels per row."""
    cells = F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))
    return frame.withColumn("cell_y", F.explode(cells))


def _patch(pixels: DataFrame) -> list[str]:
    """The patch, if rows were dealt by it."""
    return [c for c in PATCH if c in pixels.columns]


def _items(spark: SparkSession, sf_dir: str, by_place: bool) -> DataFrame:
    """Line items with their scene id, dealt out by it or by place before a row unfolds into pixels."""
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    quantity = F.col("l_quantity").cast("bigint")
    keys = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    scene = F.concat_ws("-", *[part.cast("string") for part in (*keys, cents, quantity)])
    place = F.col("l_suppkey") if by_place else None
    return _dealt(spark, sf_dir, "lineitem", scene, place).withColumns(
        {"price": F.floor("l_extendedprice").cast("bigint"), "quantity": quantity}
    )


@once
def optical_pixels(spark: SparkSession, sf_dir: str, by_place: bool = False) -> DataFrame:
    price, quantity = F.col("price"), F.col("quantity")
    bands = {
        b: ((price * p + F.col("cell_y") * c + quantity * q) % 10000).cast("int")
        for b, (p, c, q) in BAND_FACTORS.items()
    }
    masked = (F.col("l_partkey") + F.col("cell_y")) % 5 == 0
    bands["b5"] = F.when(~masked, bands["b5"])
    pixels = _pixels(_items(spark, sf_dir, by_place))
    return pixels.select(
        *_patch(pixels),
        "scene_id",
        F.col("l_shipdate").alias("ts"),
        F.col("l_partkey").cast("string").alias("mgrs_tile"),
        F.col("l_suppkey").alias("cell_x"),
        "cell_y",
        *[bands[b].alias(b) for b in OPTICAL_BANDS],
    )


@once
def cloud_pixels(spark: SparkSession, sf_dir: str, by_place: bool = False) -> DataFrame:
    """Ten times the discount; an undiscounted item has no cloud score at all."""
    pixels = _pixels(_items(spark, sf_dir, by_place).filter(F.col("l_discount") > 0))
    return pixels.select(
        *_patch(pixels),
        "scene_id",
        F.col("l_shipdate").alias("ts"),
        F.col("l_suppkey").alias("cell_x"),
        "cell_y",
        (F.col("l_discount") * 10).alias("cs_cdf"),
    )


@once
def sar_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = F.col("o_custkey")
    both = F.array(F.lit("VH"), F.lit("VV"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("scene_id"),
        F.col("o_orderdate").alias("ts"),
        F.when(customer % 23 == 0, "EW").otherwise("IW").alias("mode"),
        F.when(F.col("o_orderstatus") == "P", "DESCENDING").otherwise("ASCENDING").alias("pass"),
        F.when(customer % 19 == 0, 150).otherwise(77).alias("rel_orbit"),
        F.when(customer % 17 == 0, F.array(F.lit("VV"))).otherwise(both).alias("pols"),
    )


@once
def sar_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    scene = F.col("o_orderkey").cast("string")
    orders = _dealt(spark, sf_dir, "orders", scene).withColumn("cell_x", F.col("o_orderkey") % stations)
    level = -F.col("o_totalprice") / F.lit(65537.0)
    masked = (F.col("o_orderkey") + F.col("cell_y")) % 7 == 0
    return _pixels(orders).select(
        "scene_id",
        F.col("o_orderdate").alias("ts"),
        "cell_x",
        "cell_y",
        F.when(~masked, level).alias("vv"),
        (level - F.col("o_custkey") % 7).alias("vh"),
        (F.col("o_orderkey") % 15 + 30).cast("double").alias("angle"),
    )


@once
def met_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = (
        table(spark, sf_dir, "events")
        .groupBy((F.col("user_id") % 10).alias("cell_x"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("__h"))
        .agg(
            F.avg("value").alias("__v"), F.min("event_id").alias("__e"), F.max("user_id").alias("__u")
        )
    )
    copy = F.explode(F.sequence(F.lit(0), F.lit(EVENT_COPIES - 1)))
    moved = measured.withColumn("__k", copy)
    shift = F.make_dt_interval(F.col("__k") * EVENT_DAYS + EVENT_SHIFT)
    warmth = F.lit(273.15) + F.col("__v") / 10
    return moved.select(
        (F.col("__h") + shift).alias("hour"),
        "cell_x",
        F.lit(0).cast("bigint").alias("cell_y"),
        warmth.alias("t2m"),
        (warmth - F.col("__e") % 15).alias("d2m"),
        (F.col("__e") % 7 - 3).cast("double").alias("u10"),
        (F.col("__u") % 5 - 2).cast("double").alias("v10"),
        (F.col("__v") * F.lit(1e9) / F.lit(65537.0)).alias("ssrd"),
    )


@once
def rain_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 10).alias("cell_x"))
        .agg((F.sum("o_totalprice") / F.lit(65537.0)).alias("precipitation"))
        .select("day", "cell_x", F.lit(0).cast("bigint").alias("cell_y"), "precipitation")
    )


@once
def et_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            standard_period(F.to_date("l_shipdate")).alias("period_start"),
            F.col("l_suppkey").alias("cell_x"),
        )
        .agg(
            F.min(F.floor(F.col("l_extendedprice") / 3)).cast("int").alias("et_dn"),
            (F.sum("l_linenumber") % 256).cast("int").alias("et_qc"),
        )
        .select("period_start", "cell_x", F.lit(0).cast("bigint").alias("cell_y"), "et_dn", "et_qc")
    )


@once
def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station coordinates lie off every cell border of the stand-in grids."""
    key = F.col("s_suppkey")
    north = F.floor(key / 10) % 400
    return table(spark, sf_dir, "supplier").select(
        key.cast("string").alias("station_id"),
        F.col("s_name").alias("station"),
        (F.lit(-75.013) + (key % 10) * F.lit(0.05)).alias("longitude"),
        (F.lit(-12.017) + north * F.lit(0.05)).alias("latitude"),
        key.alias("station_key"),
    )


@once
def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("station_key")
    zero = F.lit(0).cast("bigint")
    placed = stations(spark, sf_dir).withColumns(
        {
            "cell_x": key,
            "cell_y": zero,
            "met_x": key % 10,
            "met_y": zero,
            "rain_x": key % 10,
            "rain_y": zero,
            "era5_sampling_longitude": F.col("longitude") + F.lit(0.01),
            "era5_sampling_latitude": F.col("latitude") - F.lit(0.01),
            "era5_sampling_distance_m": (key % 10 * 10 + 1000).cast("double"),
        }
    )
    return with_pixel_id(placed, ET_STEP_M, ET_STEP_M).drop("station_key")


@once
def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    def entries(scale: str, geom: str, weights: tuple[float, ...]) -> list[Column]:
        return [
            F.struct(
                F.col(geom).alias("geom_id"),
                F.lit(scale).alias("scale"),
                F.lit(px).cast("bigint").alias("cell_y"),
                F.lit(weight).alias("weight"),
            )
            for px, weight in enumerate(weights)
        ]

    rows = entries("footprint", "geom_id", FOOTPRINT_WEIGHTS) + entries(
        "local_60m", "station_id", LOCAL_WEIGHTS
    )
    placed = sites(spark, sf_dir).select("geom_id", "station_id", "cell_x")
    return placed.select("cell_x", F.explode(F.array(*rows)).alias("r")).select(
        "r.geom_id", "r.scale", "cell_x", "r.cell_y", "r.weight"
    )


@once
def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(
        et_pixels=et_pixels(spark, sf_dir),
        optical_pixels=optical_pixels(spark, sf_dir),
        cloud_pixels=cloud_pixels(spark, sf_dir),
        sar_scenes=sar_scenes(spark, sf_dir),
        sar_pixels=sar_pixels(spark, sf_dir),
        met_hourly=met_hourly(spark, sf_dir),
        rain_daily=rain_daily(spark, sf_dir),
    )


@once
def inputs_by_place(spark: SparkSession, sf_dir: str) -> Inputs:
    """The same tables with optical and cloud pixels dealt by patch, as `layout.save_by_patch` has them."""
    return replace(
        inputs(spark, sf_dir),
        optical_pixels=optical_pixels(spark, sf_dir, True),
        cloud_pixels=cloud_pixels(spark, sf_dir, True),
    )


@once
def places(spark: SparkSession, sf_dir: str) -> Places:
    return Places(
        sites(spark, sf_dir), bridge(spark, sf_dir), ERA5_SUPPORT_M, CHIRPS_SUPPORT_M
    )


@once
def met_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells within six of any station's own cell, two of five of them valid land."""
    column, row = MET_GRID.index(F.col("longitude"), F.col("latitude"))
    own = stations(spark, sf_dir).select(column.alias("cx"), row.alias("cy")).distinct()
    steps = F.sequence(F.lit(-6), F.lit(6))
    near = own.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    cells = near.select(
        (F.col("cx") + F.col("dx")).alias("cell_x"), (F.col("cy") + F.col("dy")).alias("cell_y")
    ).distinct()
    return cells.filter((F.col("cell_x") * 7 + F.col("cell_y") * 3) % 5 >= 3)


@once
def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel per part, 50 columns wide; parts of size 7 are masked."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (key % 50).alias("cell_x"),
        F.floor(key / 50).alias("cell_y"),
        F.when(F.col("p_size") != 7, F.col("p_retailprice")).alias("value"),
    )
