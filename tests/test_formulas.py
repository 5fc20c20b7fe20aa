"""Calendar, quality bits, weather formulas, indices and projections, by hand-computed values."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from terraloom import AnalysisConfig
from terraloom.functions import atmosphere, calendar, et_quality, spectral
from terraloom.functions.geodesy import haversine_m
from terraloom.functions.masks import nan_as_null
from terraloom.sources.grids import Grid, pixel_id


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("r")).head()[0]


@pytest.mark.parametrize(
    "start, end, days",
    [
        (date(2021, 1, 1), date(2021, 1, 9), 8),
        (date(2021, 12, 27), date(2022, 1, 1), 5),
        (date(2020, 12, 26), date(2021, 1, 1), 6),
        (date(2020, 2, 26), date(2020, 3, 5), 8),
    ],
)
def test_period_end(spark, start, end, days):
    assert one(spark, calendar.period_end(F.col("d")), d=start) == end
    assert one(spark, calendar.number_days(F.col("d")), d=start) == days
    assert one(spark, calendar.last_day(F.col("d")), d=start) == end.fromordinal(end.toordinal() - 1)


def test_46_periods_cover_a_year(spark):
    starts = [date.fromordinal(date(2021, 1, 1).toordinal() + 8 * i) for i in range(46)]
    frame = spark.createDataFrame([(s,) for s in starts], "d date")
    total = frame.agg(F.sum(calendar.number_days(F.col("d")))).head()[0]
    assert total == 365


def test_epoch_and_key_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
        assert one(spark, calendar.epoch_millis(F.col("d")), d=date(1970, 1, 2)) == 86_400_000
        frame = spark.createDataFrame([(datetime(2021, 3, 4, 23, 59),)], "t timestamp_ntz")
        assert frame.select(calendar.date_key(F.col("t"))).head()[0] == "2021-03-04"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize(
    "dn, qc, good, code",
    [
        (100, 0, 1, 0),
        (100, 1, 0, 0),
        (100, 4, 0, 0),
        (100, 32, 1, 1),
        (100, 64, 0, 2),
        (100, 2, 1, 0),
        (100, 8, 1, 0),
        (100, 16, 1, 0),
        (0, 0, 1, 0),
        (32700, 0, 1, 0),
        (-1, 0, 0, 0),
        (32701, 0, 0, 0),
        (None, 0, 0, 0),
        (None, None, 0, 255),
        (5, 199, 0, 6),
    ],
)
def test_quality_bits(spark, dn, qc, good, code):
    frame = spark.createDataFrame([(dn, qc)], "dn int, qc int")
    row = frame.select(
        et_quality.good_flag(F.col("dn"), F.col("qc")), et_quality.cloud_code(F.col("qc"))
    ).head()
    assert tuple(row) == (good, code)


def test_et_scaling(spark):
    assert one(spark, et_quality.et_period(F.col("dn")), dn=123) == pytest.approx(12.3)
    assert one(spark, et_quality.et_per_day(F.col("dn"), F.lit(8)), dn=123) == pytest.approx(1.5375)


def test_vapour_pressure_deficit(spark):
    frame = spark.createDataFrame(
        [(20.0, 10.0), (10.0, 20.0), (None, 5.0)], "t double, d double"
    ).coalesce(1)
    deficit = atmosphere.vapour_pressure_deficit(F.col("t"), F.col("d"))
    values = [r[0] for r in frame.select(deficit).collect()]
    assert values[0] == pytest.approx(1.1102, abs=1e-3)
    assert values[1:] == [0.0, None]


def test_wind_and_saturation(spark):
    assert one(spark, atmosphere.wind_speed(F.col("u"), F.col("v")), u=3.0, v=4.0) == 5.0
    assert one(
        spark, atmosphere.saturation_vapour_pressure(F.col("t")), t=0.0
    ) == pytest.approx(0.6108)


@pytest.mark.parametrize(
    "a, b, expected",
    [(0.5, 0.1, 4 / 6), (0.0, 0.0, None), (-0.1, 0.5, None), (0.5, None, None), (0.2, 0.2, 0.0)],
)
def test_normalized_difference(spark, a, b, expected):
    frame = spark.createDataFrame([(a, b)], "a double, b double")
    value = frame.select(spectral.normalized_difference(F.col("a"), F.col("b"))).head()[0]
    assert value == (pytest.approx(expected) if expected is not None else None)


def test_nan_becomes_null(spark):
    frame = nan_as_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int"))
    assert {r["k"]: r["x"] for r in frame.collect()} == {1: None, 2: 2.0}


@pytest.mark.parametrize("kind, lat", [("utm18n", 4.5), ("utm18n", -11.9), ("utm18s", -33.0), ("sinusoidal", -12.0)])
def test_projection_round_trip(spark, kind, lat):
    grid = Grid("g", kind, 0.0, 0.0, 20.0, 20.0, 20.0)
    points = spark.createDataFrame([(-77.3, lat), (-75.0, lat), (-73.1, lat)], "lon double, lat double")
    there = grid.project(points, "lon", "lat", "x", "y")
    back = grid.unproject(there, "x", "y", "lon2", "lat2").collect()
    for row in back:  # 1e-7 degrees is about one centimetre
        assert row["lon2"] == pytest.approx(row["lon"], abs=1e-7)
        assert row["lat2"] == pytest.approx(row["lat"], abs=1e-7)


def test_utm_known_point(spark):
    """Central meridian on the equator, and a meridian arc: 1 degree is 110,574.4 m times 0.9996."""
    grid = Grid("g", "utm18n", 0.0, 0.0, 20.0, 20.0, 20.0)
    points = spark.createDataFrame([(-75.0, 0.0), (-75.0, 1.0)], "lon double, lat double").coalesce(1)
    rows = grid.project(points, "lon", "lat", "x", "y").collect()
    assert (rows[0]["x"], rows[0]["y"]) == (pytest.approx(500000), pytest.approx(0))
    assert rows[1]["y"] == pytest.approx(110574.388 * 0.9996, abs=0.05)


def test_haversine(spark):
    frame = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    found = frame.select(haversine_m(*[F.col(c) for c in "abcd"])).head()[0]
    assert found == pytest.approx(111195.08, abs=0.1)


def test_pixel_id(spark):
    assert one(spark, pixel_id(F.col("x"), F.col("y")), x=11000, y=5000) == 10110001005000


def test_window_must_be_positive():
    with pytest.raises(ValueError):
        AnalysisConfig(start=date(2021, 1, 1), end=date(2021, 1, 1))
