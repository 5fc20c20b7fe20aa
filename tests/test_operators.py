"""Operators on small tables, against brute force or hand-computed results."""

import random
import statistics
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from plan_helpers import plan_text
from pyspark.sql import functions as F

from terraloom.operators import medians, observations, optical, periods, radar, resample, stations, weather, zonal
from terraloom.operators.bounds import bounds_of, with_block
from terraloom.operators.worklist import pending, with_quarters
from terraloom.config import AnalysisConfig
from terraloom.session import CO_PARTITION, SETTINGS
from terraloom.sources import layout, scans
from terraloom.sources.grids import Grid, read_grid

PIXEL = "scene_id string, ts timestamp_ntz, cell_x bigint, cell_y bigint, b1 int, b2 int"
CLOUD = "scene_id string, cell_x bigint, cell_y bigint, cs_cdf double"
START = date(2021, 1, 1)
PERIOD = "period_start date, dd date, ts timestamp_ntz, scene_id string, cell_x bigint, cell_y bigint"


def composites(spark, *starts):
    return spark.createDataFrame([(s,) for s in starts], "period_start date")


def test_clear_threshold_missing_score_and_joint_mask(spark):
    noon = datetime(2021, 1, 1, 12)
    pixels = spark.createDataFrame(
        [
            ("at", noon, 0, 0, 1, 2),
            ("below", noon, 0, 0, 1, 2),
            ("none", noon, 0, 0, 1, 2),
            ("nan", noon, 0, 0, 1, 2),
            ("masked", noon, 0, 0, 1, None),
        ],
        PIXEL,
    )
    cloud = spark.createDataFrame(
        [("at", 0, 0, 0.6), ("below", 0, 0, 0.59), ("nan", 0, 0, float("nan")), ("masked", 0, 0, 1.0)],
        CLOUD,
    )
    clear = optical.clear_pixels(pixels, cloud, ["b1", "b2"], 0.6)
    assert [r["scene_id"] for r in clear.collect()] == ["at"]
    flagged = optical.screened(optical.link_cloud_score(pixels, cloud), ["b1", "b2"], 0.6)
    rows = {r["scene_id"]: (r["valid"], r["b1"]) for r in flagged.collect()}
    assert rows == {
        "at": (1, 1), "below": (0, None), "none": (0, None), "nan": (0, None), "masked": (0, None)
    }


def clear_rows(spark, rows):
    """rows: (day offset, hour, scene, cell, b1, b2)"""
    data = []
    for day, hour, scene, cell, b1, b2 in rows:
        at = datetime(2021, 1, 1) + timedelta(days=day, hours=hour)
        data.append((START, at.date(), at, scene, cell, 0, b1, b2))
    return spark.createDataFrame(data, PERIOD + ", b1 int, b2 int")


def test_mosaic_takes_the_last_scene(spark):
    rows = clear_rows(
        spark, [(0, 9, "a", 1, 1, 1), (0, 10, "a", 1, 2, 2), (0, 10, "b", 1, 3, 3), (1, 1, "a", 1, 4, 4)]
    )
    (row,) = optical.daily_stack(rows, ["b1", "b2"]).collect()
    assert {day["slot"]: day["b1"] for day in row["days"]} == {0: 3, 1: 4}


def test_medoid_tie_prefers_the_earlier_day(spark):
    rows = clear_rows(spark, [(3, 0, "x", 1, 200, 10), (1, 0, "y", 1, 100, 10)])
    row = optical.medoid(optical.daily_stack(rows, ["b1", "b2"]), ["b1", "b2"]).head()
    assert (row["date_key"], row["b1"], row["clear_days"]) == ("2021-01-02", 100, 2)


def test_medoid_against_brute_force(spark):
    rng = random.Random(4)
    rows = [
        (rng.randrange(8), rng.randrange(24), f"s{i}", rng.randrange(12), rng.randrange(60), rng.randrange(60))
        for i in range(400)
    ]
    found = optical.medoid(optical.daily_stack(clear_rows(spark, rows), ["b1", "b2"]), ["b1", "b2"])
    expected = {}
    for cell in {r[3] for r in rows}:
        days = {}
        for day, hour, scene, c, b1, b2 in rows:
            if c == cell and (hour, scene) > days.get(day, ((-1, ""),))[0]:
                days[day] = ((hour, scene), (b1, b2))
        bands = {d: v[1] for d, v in days.items()}
        middle = [statistics.median(b[i] for b in bands.values()) for i in (0, 1)]
        score = {d: sum((b[i] - middle[i]) ** 2 for i in (0, 1)) for d, b in bands.items()}
        day = min(bands, key=lambda d: (score[d], d))
        expected[cell] = (str(START + timedelta(days=day)), *bands[day])
    assert {r["cell_x"]: (r["date_key"], r["b1"], r["b2"]) for r in found.collect()} == expected


def test_radar_bands_have_their_own_masks(spark):
    rows = spark.createDataFrame(
        [
            ("r1", START, 1, 0, -10.0, -20.0, 30.0),
            ("r2", START, 1, 0, -14.0, None, 32.0),
            ("r3", START, 1, 0, None, -22.0, 34.0),
            ("r1", START, 2, 0, None, -5.0, 30.0),
        ],
        "scene_id string, period_start date, cell_x bigint, cell_y bigint, vv double, vh double, angle double",
    )
    found = {r["cell_x"]: r for r in radar.radar_medians(rows).collect()}
    assert (found[1]["VV_dB"], found[1]["VH_dB"], found[1]["VV_minus_VH_dB"]) == (-12.0, -21.0, 9.0)
    assert found[1]["Angle_deg"] == 32.0
    assert found[2]["VV_dB"] is None and found[2]["VV_minus_VH_dB"] is None


def test_a_repeated_radar_pixel_is_an_error(spark):
    rows = spark.createDataFrame(
        [("r1", START, 1, 0, 1.0, 1.0, 1.0), ("r1", START, 1, 0, 2.0, 2.0, 2.0), ("r2", START, 2, 0, 1.0, 1.0, 1.0)],
        "scene_id string, period_start date, cell_x bigint, cell_y bigint, vv double, vh double, angle double",
    )
    with pytest.raises(Exception, match="sar_pixels holds 2 rows of 1 scenes at 2021-01-01 1 0"):
        radar.radar_medians(rows).collect()
    assert radar.radar_medians(rows.filter("cell_x = 2")).count() == 1
    text = plan_text(radar.radar_medians(rows))
    assert text.split("== Physical Plan ==")[-1].count("Exchange") == 1


def test_single_rows_pass_and_second_ones_are_errors(spark):
    rows = spark.createDataFrame([(1, 2, None), (2, 3, 4), (2, 5, 6)], "k int, a int, b int")
    once = observations.single(rows, ["k"], "table")
    assert [tuple(r) for r in once.filter("k = 1").collect()] == [(1, 2, None)]
    with pytest.raises(Exception, match="table holds 2 rows at 2"):
        once.collect()


@pytest.mark.parametrize("size", [7, 8, 1501, 2000])
def test_hot_groups_have_exact_medians(spark, size):
    rng = random.Random(size)
    data = [(1, rng.gauss(0, 5), rng.choice([None, 3.0, rng.random()])) for _ in range(size)]
    data += [(2, 1.0, 2.0), (2, 4.0, None)] + [(3, 7.5, None)] * 40
    rows = spark.createDataFrame(data, "k int, x double, y double")
    got = medians.spread_medians(rows, ["k"], ["x", "y"])

    def expected(k, i):
        values = [r[i] for r in data if r[0] == k and r[i] is not None]
        return statistics.median(values) if values else None

    assert {r["k"]: (r["x"], r["y"]) for r in got.collect()} == {
        k: (expected(k, 1), expected(k, 2)) for k in (1, 2, 3)
    }


BRIDGE = "geom_id string, cell_x bigint, cell_y bigint, weight double"


def test_coverage_counts_absent_pixels_and_reaches_the_threshold_exactly(spark):
    bridge = spark.createDataFrame(
        [("g", 1, 0, 999.0), ("g", 2, 0, 1.0), ("h", 3, 0, 1.0), ("h", 4, 0, 0.5), ("none", 90, 90, 1.0)], BRIDGE
    )
    rows = clear_rows(spark, [(0, 0, "a", 1, 0, 0), (0, 0, "a", 3, 0, 0)])
    found = zonal.zone_summary(rows, [F.lit(True)], bridge)
    share = {r["geom_id"]: r["share"] for r in found.collect()}
    assert share["g"] == 0.999 and share["h"] == pytest.approx(2 / 3) and "none" not in share


def test_scene_dates_include_cloudy_and_repeat_days(spark):
    bridge = spark.createDataFrame([("g", 1, 0, 1.0), ("g", 2, 0, 1.0), ("g", 3, 0, 0.0)], BRIDGE)
    rows = clear_rows(
        spark,
        [(2, 0, "b", 1, 0, 0), (2, 0, "b", 2, 0, 0), (0, 0, "a", 1, 0, 0), (2, 5, "c", 1, 0, 0), (3, 0, "d", 3, 0, 0)],
    )
    row = zonal.zone_summary(rows, [F.lit(False)], bridge).head()
    assert (row["dates_total"], row["dates"], row["products_total"]) == (2, "2021-01-01;2021-01-03", 3)
    assert row["share"] == 0.0


def test_zone_summary_against_plain_sets(spark):
    """Geometries over many patches, negative cells too, and masks held by different scenes."""
    rng = random.Random(6)
    cells = [(x, y) for x in range(-20, 15) for y in range(-12, 12)]
    bridge = [
        (g, x, y, rng.choice([1.0, 1.0, 0.25, 0.5])) for g in "abc" for x, y in rng.sample(cells, 200)
    ]
    pixels = []
    for scene in range(7):
        day = rng.randrange(16)
        for x, y in rng.sample(cells, 300):
            at = datetime(2021, 1, 1) + timedelta(days=day)
            period = START + timedelta(days=8 * (day // 8))
            values = [rng.choice([None, 1.0, 2.0]) for _ in range(2)]
            pixels.append((period, at.date(), at, f"s{scene}", x, y, *values))
    rows = spark.createDataFrame(pixels, PERIOD + ", vv double, vh double")
    masks = [F.col("vv").isNotNull(), F.col("vh").isNotNull()]
    found = zonal.zone_summary(rows, masks, spark.createDataFrame(bridge, BRIDGE), once="pixels")
    expected = {}
    for period in {p[0] for p in pixels}:
        own = [p for p in pixels if p[0] == period]
        held = [{p[4:6] for p in own if p[k] is not None} for k in (6, 7)]
        for g in "abc":
            weights = {(x, y): w for name, x, y, w in bridge if name == g}
            scenes = {(p[1], p[3]) for p in own if p[4:6] in weights}
            covered = sum(w for c, w in weights.items() if c in held[0] and c in held[1])
            days = sorted({str(d) for d, _ in scenes})
            expected[g, period] = (covered / sum(weights.values()), len(days), ";".join(days), len(scenes))
    got = {(r["geom_id"], r["period_start"]): tuple(r)[2:] for r in found.collect()}
    assert got == {k: (pytest.approx(v[0]), *v[1:]) for k, v in expected.items()}
    twice = rows.unionByName(rows.limit(1))
    with pytest.raises(Exception, match="pixels holds .* rows of .* cells"):
        zonal.zone_summary(twice, masks, spark.createDataFrame(bridge, BRIDGE), once="pixels").collect()
    assert zonal.zone_summary(twice, masks, spark.createDataFrame(bridge, BRIDGE)).count() == len(expected)


def test_zone_summary_shuffles_bits_not_pixels(spark):
    rows = spark.range(8000).selectExpr(
        "date'2021-01-01' as period_start", "date'2021-01-02' as dd", "cast(id % 2 as string) as scene_id",
        "id % 80 as cell_x", "(id div 160) as cell_y",
    )
    bridge = spark.createDataFrame([("g", 1, 0, 1.0)], BRIDGE)
    physical = plan_text(zonal.zone_summary(rows, [F.lit(True)], bridge)).split("== Physical Plan ==")[-1]
    assert "partial_bit_or" in physical and "Window" not in physical
    for line in physical.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "cell_x" not in line and "cell_y" not in line


def test_zone_summary_moves_scene_names_only_for_their_number(spark):
    rows = clear_rows(spark, [(0, 0, "a", 1, 0, 0), (0, 0, "a", 9, 0, 0), (2, 0, "b", 9, 0, 0)])
    bridge = spark.createDataFrame([("g", 1, 0, 1.0), ("g", 9, 0, 1.0), ("h", 9, 0, 1.0)], BRIDGE)
    found = zonal.zone_summary(rows, [F.lit(True)], bridge)
    # "g" has two patches that share a scene, "h" one patch.
    assert {r["geom_id"]: (r["products_total"], r["dates_total"]) for r in found.collect()} == {"g": (2, 2), "h": (2, 2)}
    assert "collect_list(struct(dd" in plan_text(found).split("== Physical Plan ==")[-1]
    assert "collect_list(struct(dd" not in plan_text(found.drop("products_total")).split("== Physical Plan ==")[-1]


def test_zonal_statistics_match_numpy_and_survive_an_offset(spark):
    rng = np.random.default_rng(1)
    weights, values = rng.random(40), rng.random(40) * 1e-3 + 1e6
    rows = [(START, i, 0, None if i == 3 else float(v), 40.0) for i, v in enumerate(values)]
    predictors = spark.createDataFrame(rows, "period_start date, cell_x bigint, cell_y bigint, a double, b double")
    bridge = spark.createDataFrame(
        [("g", "footprint", i, 0, float(w)) for i, w in enumerate(weights)],
        "geom_id string, scale string, cell_x bigint, cell_y bigint, weight double",
    )
    found = zonal.zonal_statistics(predictors, bridge, ["a", "b"], {"a": 1e6})
    row = found.head()
    w, v = np.delete(weights, 3), np.delete(values, 3)
    mean = np.average(v, weights=w)
    assert row["a_mean"] == pytest.approx(mean, rel=1e-12)
    assert row["a_stdDev"] == pytest.approx(np.sqrt(np.average((v - mean) ** 2, weights=w)), rel=1e-4)
    assert (row["b_mean"], row["b_stdDev"]) == (pytest.approx(40.0), pytest.approx(0.0, abs=1e-9))


def test_zonal_statistics_combine_before_their_only_shuffle(spark):
    predictors = spark.range(1000).selectExpr(
        "date'2021-01-01' as period_start", "id % 10 as cell_x", "id div 10 as cell_y", "rand(1) as a", "rand(2) as VV_dB"
    )
    bridge = spark.range(1000).selectExpr(
        "cast(id % 3 as string) as geom_id", "'footprint' as scale", "id % 10 as cell_x", "id div 10 as cell_y", "1.0D as weight"
    )
    text = plan_text(zonal.zonal_statistics(predictors, bridge, ["a", "VV_dB"]))
    physical = text.split("== Physical Plan ==")[-1]
    assert physical.count("HashAggregate") == 2 and "Window" not in physical
    assert "partial_sum" in physical
    above_join = physical.split("Join")[0]
    assert above_join.count("Exchange") == 1


def test_zones_of_closed_patches_are_whole_and_others_merge(spark):
    rng = random.Random(11)
    geometries = {
        ("alone", "footprint"): [(x, y) for x in range(3) for y in range(2)],
        ("alone", "local_60m"): [(x, 0) for x in range(2)],
        ("wide", "footprint"): [(x, 1) for x in range(28, 45)],
        ("beside", "footprint"): [(33, 2), (34, 2), (34, 1)],
        ("below", "footprint"): [(-1, -1), (-8, -8)],
        ("empty", "footprint"): [(90, 90)],
    }
    bridge = [(g, s, x, y, rng.choice([1.0, 0.25])) for (g, s), cells in geometries.items() for x, y in cells]
    rows = [
        (date(2021, 1, 1 + 8 * p), x, y, kind, None if rng.random() < 0.2 else rng.random())
        for p in range(2) for x in range(-9, 50) for y in range(-9, 4) for kind in "ab"
        if rng.random() < 0.7 and (kind, p, x > 20) != ("b", 1, True)
    ]
    cells = spark.createDataFrame(rows, "period_start date, cell_x bigint, cell_y bigint, kind string, v double")

    def source(kind):
        pixels = zonal.by_patch(cells.filter(F.col("kind") == kind).withColumnRenamed("v", kind).drop("kind"))
        return zonal.Source(pixels, lambda composed: composed, [kind])

    zones = spark.createDataFrame(bridge, "geom_id string, scale string, cell_x bigint, cell_y bigint, weight double")
    closed = zonal.closed_patches(zones).filter("closed").select("geom_id").distinct()
    assert {r["geom_id"] for r in closed.collect()} == {"alone", "below", "empty"}
    found = zonal.statistics_of([source("a"), source("b")], zones)
    expected = {}
    for geom, scale, x, y, weight in bridge:
        for period, cell_x, cell_y, kind, value in rows:
            if (x, y) == (cell_x, cell_y):
                zone = expected.setdefault((geom, scale, period), {"a": [], "b": []})
                if value is not None:
                    zone[kind].append((weight, value))
    assert {(r["geom_id"], r["scale"], r["period_start"]) for r in found.collect()} == set(expected)
    assert found.count() == len(expected)
    for r in found.collect():
        for kind, held in expected[r["geom_id"], r["scale"], r["period_start"]].items():
            if not held:
                assert r[f"{kind}_mean"] is None and r[f"{kind}_stdDev"] is None
                continue
            w, v = np.array(held).T
            mean = np.average(v, weights=w)
            assert r[f"{kind}_mean"] == pytest.approx(mean)
            assert r[f"{kind}_stdDev"] == pytest.approx(np.sqrt(np.average((v - mean) ** 2, weights=w)), abs=1e-7)


def test_moments_merge(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k), int(p), float(w), float(x)) for k, p, w, x in
            zip(rng.integers(0, 3, 400), rng.integers(0, 5, 400), rng.random(400), rng.normal(-12, 2, 400), strict=True)]
    rows += [(7, 0, 1.0, 0.3), (7, 1, 0.1, 0.3), (8, 0, 1.0, None), (9, 0, 0.0, 1.0), (9, 1, 0.0, 2.0)]
    placed = spark.createDataFrame(rows, "k int, part int, weight double, VV_dB double")
    fine = zonal.band_moments(placed, ["k", "part"], ["VV_dB"])
    whole = zonal.merged_moments(fine, ["k"], ["VV_dB"])
    found = {r["k"]: r for r in zonal.moment_statistics(whole, ["k"], ["VV_dB"]).collect()}
    for k in range(3):
        w, x = (np.array([r[i] for r in rows if r[0] == k]) for i in (2, 3))
        mean = np.average(x, weights=w)
        assert found[k]["VV_dB_mean"] == pytest.approx(mean, rel=1e-13)
        assert found[k]["VV_dB_stdDev"] == pytest.approx(np.sqrt(np.average((x - mean) ** 2, weights=w)), rel=1e-12)
    assert tuple(found[7])[1:] == (0.3, 0.0) and tuple(found[8])[1:] == (None, None)
    assert tuple(found[9])[1:] == (None, None)


def test_bounds_keep_wanted_cells_only(spark):
    pixels = spark.range(5000).select((F.col("id") - 2500).alias("cell_x"), (F.col("id") % 7).alias("cell_y"))
    cells = spark.createDataFrame([(-33, 5), (10, 4), (10, 4), (2000, 0)], "cell_x bigint, cell_y bigint")
    bounds = bounds_of(cells)
    wanted = {(-33, 5), (10, 4), (2000, 0)}
    expected = sorted(tuple(r) for r in pixels.collect() if tuple(r) in wanted)
    assert sorted(tuple(r) for r in bounds.restrict(pixels).collect()) == expected
    near = {(r["cell_x"] >> 5, r["cell_y"] >> 5) for r in bounds.near(pixels).collect()}
    assert near == {(-2, 0), (0, 0), (62, 0)}


def test_partitioned_pixels_are_pruned_by_block(spark, tmp_path):
    pixels = spark.range(4000).select((F.col("id") % 2000).alias("cell_x"), F.lit(0).cast("bigint").alias("cell_y"))
    path = str(tmp_path / "pixels")
    with_block(pixels).write.partitionBy("block_x", "block_y").parquet(path)
    cells = spark.range(10, 13).select(F.col("id").alias("cell_x"), F.lit(0).cast("bigint").alias("cell_y"))
    stored = spark.read.parquet(path)
    listed = str(tmp_path / "cells")
    cells.write.parquet(listed)
    found = bounds_of(spark.read.parquet(listed).filter("cell_x > 0")).restrict(stored)
    assert found.count() == 6
    assert "dynamicpruning" in plan_text(found)


SMALL = Grid("s", "utm18n", 7.0, -11.0, 30.0, -30.0, 30.0)
LARGE = Grid("t", "utm18n", 0.0, 0.0, 20.0, 20.0, 20.0)


@pytest.mark.parametrize(("source", "target"), [(SMALL, LARGE), (LARGE, SMALL), (LARGE, LARGE)])
def test_wanted_blocks_draw_on_their_source_blocks_only(spark, source, target):
    wanted = bounds_of(spark.createDataFrame([(40, -3), (41, 70), (-1, 0)], "cell_x bigint, cell_y bigint"))
    # Source pixels around all that the wanted blocks can reach, and far away.
    side = spark.range(-160, 260)
    pixels = side.select(F.col("id").alias("cell_x")).join(side.select(F.col("id").alias("cell_y")), F.lit(True))
    far = pixels.withColumn("cell_x", F.col("cell_x") + 100_000)
    value = (F.col("cell_x") * 7 + F.col("cell_y") * 13) % 101
    pixels = pixels.unionByName(far).withColumn("v", F.when(F.col("cell_x") % 17 != 0, value.cast("double")))
    whole = wanted.near(resample.resample_bilinear(pixels, ["v"], source, target, []))
    cut = resample.source_blocks(wanted, source, target).near(pixels)
    halo = wanted.near(resample.resample_bilinear(cut, ["v"], source, target, []))
    rounded = ["cell_x", "cell_y", F.round("v", 6).alias("v")]
    rows = sorted(map(str, halo.select(*rounded).collect()))
    assert rows == sorted(map(str, whole.select(*rounded).collect())) and len(rows) > 3 * 1024 - 200
    # Each wanted block reaches itself, scaled, and its neighbours: never the whole source.
    scale = target.step_x / source.step_x
    assert cut.count() <= 3 * (1024 * (max(abs(scale), 1) * 3 + 1) ** 2)
    assert cut.filter("cell_x > 50000").isEmpty()


def pruned_pixels(spark, path):
    """A year of pixels over 20 tiles, stored by month and tile."""
    pixels = spark.range(24_000).select(
        F.concat(F.lit("s"), (F.col("id") % 60).cast("string")).alias("scene_id"),
        F.expr("cast(date_add(date'2020-06-15', cast(pmod(hash(id, 2), 360) as int)) as timestamp_ntz)").alias("ts"),
        F.expr("cast(pmod(hash(id), 10240) as bigint)").alias("cell_x"),
        F.expr("cast(pmod(hash(id, 1), 500) as bigint)").alias("cell_y"),
        (F.col("id") % 9).cast("double").alias("cs_cdf"),
    )
    layout.write_pixels(pixels, path)
    return pixels, spark.read.parquet(path)


def test_stored_pixels_are_pruned_by_month_and_tile(spark, tmp_path):
    pixels, stored = pruned_pixels(spark, str(tmp_path / "pixels"))
    assert {"month", "tile_x", "tile_y"} <= set(stored.columns)
    assert stored.count() == pixels.count()
    config = AnalysisConfig(start=date(2021, 1, 10), end=date(2021, 3, 1))
    listed = [(x, 5) for x in range(600, 800)] + [(5000, 400)]
    bounds = bounds_of(spark.createDataFrame(listed, "cell_x bigint, cell_y bigint"))

    near = bounds.near(scans.scan_cloud(stored, config))
    plain = bounds.near(scans.scan_cloud(pixels, config))
    assert near.columns == plain.columns == ["scene_id", "ts", "cell_x", "cell_y", "cs_cdf"]
    assert sorted(map(str, near.collect())) == sorted(map(str, plain.collect())) != []
    text = plan_text(near)
    assert "dynamicpruning" in text
    filters = [x for x in text.splitlines() if "PartitionFilters" in x][0]
    assert "month" in filters and "202101" in filters and "202102" in filters and "tile_x" in filters


def test_bucketed_scenes_join_without_a_shuffle(spark):
    cells = spark.range(400).select(
        F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("scene_id"),
        F.expr("cast(date_add(date'2021-01-01', cast(id % 4 as int) * 20) as timestamp_ntz)").alias("ts"),
        F.lit("T").alias("mgrs_tile"), (F.col("id") % 20).alias("cell_x"), (F.col("id") % 7).alias("cell_y"),
        F.lit(1).alias("b1"), F.when(F.col("id") % 3 > 0, 2).alias("b2"), F.rand(3).alias("cs_cdf"),
    ).dropDuplicates(["scene_id", "cell_x", "cell_y"])
    cells = spark.createDataFrame(cells.collect(), cells.schema)
    pixels, cloud = cells.drop("cs_cdf"), cells.select("scene_id", "ts", "cell_x", "cell_y", "cs_cdf")
    names = [f"bucketed_{kind}_{random.randrange(10**9)}" for kind in ("optical", "cloud")]
    for frame, name in zip((pixels, cloud), names, strict=True):
        layout.save_bucketed(frame, name, 4)
    config = AnalysisConfig(start=date(2021, 1, 1), end=date(2021, 2, 1))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def clear(optical_pixels, cloud_pixels):
            return optical.clear_pixels(
                scans.scan_optical(optical_pixels, config, ["b1", "b2"]),
                scans.scan_cloud(cloud_pixels, config).drop("ts"), ["b1", "b2"], 0.5,
            )

        stored = clear(*map(spark.table, names))
        physical = plan_text(stored).split("== Physical Plan ==")[-1]
        assert "SortMergeJoin" in physical and "Exchange" not in physical
        assert "Exchange" in plan_text(clear(pixels, cloud))
        assert sorted(map(str, stored.collect())) == sorted(map(str, clear(pixels, cloud).collect())) != []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in names:
            spark.sql(f"drop table {name}")


def test_pixels_saved_by_patch_are_composed_without_a_shuffle(spark):
    rng = random.Random(9)
    pixels = [
        (f"s{d}", datetime(2021, 1, 1 + d), x, y, rng.randrange(90), rng.randrange(90))
        for d in range(4) for x in range(-3, 20) for y in range(5) if rng.random() < 0.8
    ]
    scores = [(s, at, x, y, rng.random()) for s, at, x, y, _, _ in pixels if rng.random() < 0.9]
    tables = [
        spark.createDataFrame(pixels, PIXEL),
        spark.createDataFrame(scores, "scene_id string, ts timestamp_ntz, cell_x bigint, cell_y bigint, cs_cdf double"),
    ]
    names = [f"patched_{kind}_{random.randrange(10**9)}" for kind in ("optical", "cloud")]
    for frame, name in zip(tables, names, strict=True):
        layout.save_by_patch(frame, name, 4)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", CO_PARTITION: SETTINGS[CO_PARTITION]}
    kept = {key: spark.conf.get(key) for key in settings}
    config, bands = AnalysisConfig(start=date(2021, 1, 1), end=date(2021, 2, 1)), ["b1", "b2"]
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)

        def composite(optical_pixels, cloud_pixels):
            optical_pixels = optical_pixels.withColumn("mgrs_tile", F.lit("T"))
            clear = optical.clear_pixels(
                scans.scan_optical(optical_pixels, config, bands), scans.scan_cloud(cloud_pixels, config), bands, 0.4
            )
            dated = clear.withColumns({"dd": F.to_date("ts"), "period_start": F.lit(START)})
            return optical.medoid(optical.daily_stack(dated, bands), bands)

        stored = composite(*map(spark.table, names))
        physical = plan_text(stored).split("== Physical Plan ==")[-1]
        assert "SortMergeJoin" in physical and "Exchange" not in physical
        assert sorted(map(str, stored.collect())) == sorted(map(str, composite(*tables).collect())) != []
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
        for name in names:
            spark.sql(f"drop table {name}")


def test_period_join_is_a_hash_join(spark):
    scenes = spark.createDataFrame(
        [("in", datetime(2021, 1, 8, 23)), ("next", datetime(2021, 1, 9)), ("out", datetime(2022, 6, 1))],
        "scene_id string, ts timestamp_ntz",
    )
    joined = periods.assign_period(scenes, "ts", composites(spark, START, date(2021, 1, 9)))
    assert {r["scene_id"]: r["period_start"] for r in joined.collect()} == {
        "in": START, "next": date(2021, 1, 9)
    }
    assert "NestedLoop" not in plan_text(joined)


def hourly(spark, hours, cells=((0, 0),)):
    rows = [
        (datetime(2021, 1, 1) + timedelta(hours=h), x, y, 283.15 + h % 24, 280.15, 3.0, 4.0, 1e6)
        for h in hours
        for x, y in cells
    ]
    return spark.createDataFrame(
        rows,
        "hour timestamp_ntz, cell_x bigint, cell_y bigint, t2m double, d2m double, u10 double, v10 double, ssrd double",
    )


def rain(spark, offsets):
    rows = [(START + timedelta(days=d), 0, 0, 2.0) for d in offsets]
    return spark.createDataFrame(rows, "day date, cell_x bigint, cell_y bigint, precipitation double")


@pytest.mark.parametrize(
    "hours, days, complete",
    [
        (range(192), range(-30, 8), 1),
        (range(191), range(-30, 8), 0),
        (range(192), range(-30, 7), 0),
        (range(192), range(-29, 8), 0),
    ],
)
def test_weather_completeness(spark, hours, days, complete):
    found = composites(spark, START)
    table, drops = hourly(spark, hours), rain(spark, days)
    sites = spark.createDataFrame(
        [("s", 0, 0, 0, 0, START)],
        "station_id string, met_x bigint, met_y bigint, rain_x bigint, rain_y bigint, period_start date",
    )
    row = weather.attach_weather(
        sites,
        weather.period_weather(weather.hourly_derived(table), found),
        weather.period_rain(drops, found, 30),
        weather.period_counts(table, drops, found, 30),
        11000.0,
        5500.0,
    ).head()
    assert row["meteo_complete"] == row["meteo_temporal_complete"] == complete
    assert row["meteo_missing_count"] == 0
    assert row["era5_hours_total"] == len(hours) and row["era5_hours_expected"] == 192
    assert row["Wind_mean_ms"] == pytest.approx(5.0)
    assert row["SolarRad_MJ_m2_day"] == pytest.approx(len(hours) / 8)
    assert row["Precip_prev30d_mm"] == pytest.approx(2.0 * sum(d < 0 for d in days))


def test_weather_of_an_empty_period(spark):
    found = composites(spark, START, date(2021, 1, 9))
    counts = weather.period_counts(hourly(spark, range(192)), rain(spark, range(8)), found, 30)
    empty = [r for r in counts.collect() if r["period_start"].day == 9][0]
    assert (empty["era5_hours_total"], empty["chirps_days_period"], empty["chirps_days_prev30"]) == (0, 0, 8)


def test_observation_grid_has_no_cross_join(spark):
    sites = spark.createDataFrame([("a",), ("b",)], "station_id string")
    grid = stations.observation_grid(sites, composites(spark, START, START, date(2021, 1, 9)))
    assert grid.count() == 4
    assert "CartesianProduct" not in plan_text(grid) and "NestedLoop" not in plan_text(grid)


MET = Grid("met", "latlon", -180.0, 90.0, 0.1, -0.1, 11132.0)


def test_nearest_cell_against_all_pairs_and_across_the_date_line(spark):
    rng = random.Random(2)
    places = [(f"s{i}", -74 + rng.random(), -11 + rng.random()) for i in range(20)]
    places.append(("line", 179.98, 10.02))
    cells = [(x, y) for x in range(1050, 1076) for y in range(995, 1016) if rng.random() < 0.2]
    cells.append((0, 799))  # just east of the date line
    found = stations.nearest_cells(
        spark.createDataFrame(places, "station_id string, longitude double, latitude double"),
        spark.createDataFrame(cells, "cell_x bigint, cell_y bigint"),
        MET,
        50_000.0,
    )
    got = {r["station_id"]: (r["met_x"], r["met_y"]) for r in found.collect()}

    def distance(lon, lat, x, y):
        a, b = np.radians(lat), np.radians(90 - (y + 0.5) * 0.1)
        gap = np.radians(-180 + (x + 0.5) * 0.1 - lon)
        h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(gap / 2) ** 2
        return 2 * 6371008.8 * np.arcsin(np.sqrt(h))

    for name, lon, lat in places:
        ranked = sorted((distance(lon, lat, x, y), y, x) for x, y in cells)
        best = ranked[0]
        assert got.get(name) == ((best[2], best[1]) if best[0] <= 50_000 else None)


def test_missing_support_raises_and_names_the_station(spark):
    places = spark.createDataFrame(
        [("near", -74.02, -11.02), ("far", 20.0, 40.0)], "station_id string, longitude double, latitude double"
    )
    cells = spark.createDataFrame([(1059, 1010)], "cell_x bigint, cell_y bigint")
    found = stations.nearest_cells(places, cells, MET, 50_000.0)
    with pytest.raises(ValueError, match="far"):
        stations.require_supports(places, found)
    with pytest.raises(ValueError, match="no station"):
        stations.require_supports(places, found.limit(0))


def test_stations_sharing_a_cell_keep_their_rows(spark):
    grid = Grid("et", "sinusoidal", -20015109.354, 10007554.677, 463.312716528, -463.312716528, 463.3)
    places = spark.createDataFrame(
        [("a", -75.0130, -12.0170), ("b", -75.0131, -12.0171), ("c", -75.2, -12.0170)],
        "station_id string, longitude double, latitude double",
    )
    placed = {r["station_id"]: r for r in stations.station_cells(places, grid).collect()}
    assert placed["a"]["modis_pixel_id"] == placed["b"]["modis_pixel_id"] != placed["c"]["modis_pixel_id"]
    assert placed["a"]["footprint_area_m2"] == pytest.approx(463.312716528**2)
    near = stations.cell_neighbourhood(stations.station_cells(places.filter("station_id < 'c'"), grid))
    assert near.count() == 25


@pytest.mark.parametrize("step_y", [20.0, -20.0])
def test_geometry_weights(spark, step_y):
    et = Grid("et", "sinusoidal", -20015109.354, 10007554.677, 463.312716528, -463.312716528, 463.3)
    analysis = Grid("a", "utm18n", 0.0, 0.0, 20.0, step_y, 20.0)
    places = spark.createDataFrame(
        [("a", -75.013, -12.017), ("b", -74.2, 3.3)], "station_id string, longitude double, latitude double"
    )
    boxes = stations.local_cells(places, analysis, 30.0).groupBy("geom_id").agg(F.sum("weight").alias("w"))
    for row in boxes.collect():
        assert row["w"] == pytest.approx(9.0, abs=1e-6)
    cells = stations.footprint_cells(stations.station_cells(places, et), et, analysis, 10)
    totals = cells.groupBy("geom_id").agg(F.sum("weight").alias("w"), F.max("weight").alias("m"))
    for row in totals.collect():
        assert row["w"] == pytest.approx(463.312716528**2 / 400, rel=0.01)
        assert row["m"] == 1.0


def test_bilinear_needs_all_neighbours(spark):
    source, target = (Grid("g", "utm18n", o, o, 20.0, 20.0, 20.0) for o in (0.0, 10.0))
    rows = [(x, y, float(x + 10 * y)) for x in range(4) for y in range(4) if (x, y) != (3, 3)]
    pixels = spark.createDataFrame(rows, "cell_x bigint, cell_y bigint, v double")
    blended = resample.resample_bilinear(pixels, ["v"], source, target, [])
    got = {(r["cell_x"], r["cell_y"]): r["v"] for r in blended.collect() if r["v"] is not None}
    assert got == {
        (x, y): pytest.approx(x + 0.5 + 10 * (y + 0.5))
        for x in range(3) for y in range(3) if (x, y) != (2, 2)
    }


def test_quarters_are_clipped(spark):
    one = spark.range(1)
    found = with_quarters(one, F.lit(date(2021, 2, 15)), F.lit(date(2021, 8, 1))).orderBy("quarter")
    assert [tuple(r)[1:] for r in found.collect()] == [
        (2021, "Q1", date(2021, 2, 15), date(2021, 4, 1)),
        (2021, "Q2", date(2021, 4, 1), date(2021, 7, 1)),
        (2021, "Q3", date(2021, 7, 1), date(2021, 8, 1)),
    ]
    work = spark.createDataFrame([("a", 2021, "Q1"), ("a", 2021, "Q2")], "station_id string, year int, quarter string")
    assert [r["quarter"] for r in pending(work, work.filter("quarter = 'Q1'")).collect()] == ["Q2"]


def test_station_index_counts_from_one(spark):
    names = [f"n{i:03d}" for i in range(300)]
    shuffled = random.Random(1).sample(names + names[:50], 350)
    frame = spark.createDataFrame([(n,) for n in shuffled], "station_id string")
    got = {r["station_id"]: r["station_index"] for r in stations.station_index(frame).collect()}
    assert got == {n: i + 1 for i, n in enumerate(names)}


def test_grid_must_be_unique(spark):
    grids = spark.createDataFrame(
        [("a", "latlon", 0.0, 0.0, 1.0, 1.0, 1.0)] * 2,
        "grid_id string, kind string, origin_x double, origin_y double, step_x double, step_y double, scale_m double",
    )
    with pytest.raises(ValueError):
        read_grid(grids, "a")
