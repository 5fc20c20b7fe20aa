"""The whole pipeline from coordinates to written partitions, on a small hand-made scene."""

from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from plan_helpers import plan_text
from pyspark.sql import functions as F

from terraloom import AnalysisConfig, job, schemas
from terraloom.operators import storage
from terraloom.operators.stations import local_cells
from terraloom.operators.worklist import with_quarters
from terraloom.plans import batches, geometry_store
from terraloom.operators.bounds import bounds_of
from terraloom.operators.zonal import footprint_cells_of
from terraloom.plans.availability import availability, optical_rows, periods_of, radar_rows
from terraloom.plans.geometry_store import GeometryStore
from terraloom.plans.inputs import Inputs
from terraloom.plans.places import resolve_places
from terraloom.plans.restriction import of_stations, window_of
from terraloom.plans.training import build_training_tables
from terraloom.sources import layout, publication, scans, sinks
from terraloom.sources.grids import Grid

CONFIG = AnalysisConfig(start=date(2021, 1, 1), end=date(2021, 1, 17), footprint_samples=4)
FIRST = datetime(2021, 1, 1)
STATIONS = [
    ("a", "Alpha", -74.9500, 4.5000),
    ("b", "Beta", -74.9501, 4.5001),
    ("c", "Gamma", -74.9000, 4.5000),
]
GRIDS = [
    ("et", "sinusoidal", -20015109.354, 10007554.677, 463.312716528, -463.312716528, 463.3),
    ("analysis", "utm18n", 0.0, 0.0, 20.0, 20.0, 20.0),
    ("met", "latlon", -180.0, 90.0, 0.1, -0.1, 11132.0),
    ("rain", "latlon", -180.0, 90.0, 0.05, -0.05, 5566.0),
]
BANDS = list(schemas.OPTICAL_BANDS)


@pytest.fixture(scope="module")
def resolved(spark):
    def rows(data, schema):
        return spark.createDataFrame(data, schema)

    stations, grids = rows(STATIONS, schemas.STATIONS), rows(GRIDS, schemas.GRIDS)
    # Weather: the stations' own cell is sea (no temperature); its neighbours are land.
    own_x, own_y = 1050, 854
    hours = [FIRST + timedelta(hours=h) for h in range(16 * 24)]
    met = [
        (h, own_x + dx, own_y, None if dx == 0 else 290.0 + dx, 280.0, 3.0, 4.0, 1e6)
        for h in hours
        for dx in (-1, 0, 1)
    ]
    days = [date(2020, 12, 1) + timedelta(days=d) for d in range(47)]
    drops = [(d, x, 1709 + y, 1.5) for d in days for x in range(2100, 2103) for y in (0, 1)]
    empty = rows([], schemas.OPTICAL_PIXELS)
    inputs = Inputs(
        et_pixels=rows([], schemas.ET_PIXELS),
        optical_pixels=empty,
        cloud_pixels=rows([], schemas.CLOUD_PIXELS),
        sar_scenes=rows(
            [
                ("r1", FIRST + timedelta(days=1), "IW", "ASCENDING", 77, ["VV", "VH"]),
                ("r2", FIRST + timedelta(days=2), "IW", "ASCENDING", 77, ["VH", "VV"]),
                ("r3", FIRST + timedelta(days=9), "IW", "ASCENDING", 77, ["VV", "VH"]),
                ("other", FIRST + timedelta(days=3), "IW", "ASCENDING", 78, ["VV", "VH"]),
                ("single", FIRST + timedelta(days=3), "IW", "ASCENDING", 77, ["VV"]),
                ("mode", FIRST + timedelta(days=3), "EW", "ASCENDING", 77, ["VV", "VH"]),
            ],
            schemas.SAR_SCENES,
        ),
        sar_pixels=rows([], schemas.SAR_PIXELS),
        met_hourly=rows(met, schemas.MET_HOURLY),
        rain_daily=rows(drops, schemas.RAIN_DAILY),
    )
    places = resolve_places(stations, grids, inputs, CONFIG)
    cells = places.bridge.select("cell_x", "cell_y").distinct()
    et = places.sites.select("cell_x", "cell_y").distinct().withColumn(
        "period_start", F.explode(F.array(F.lit(date(2021, 1, 1)), F.lit(date(2021, 1, 9))))
    ).select("period_start", "cell_x", "cell_y", F.lit(160).alias("et_dn"), F.lit(0).alias("et_qc"))

    def pixels(scene, day, base, score):
        dn = [(F.lit(base + 100 * i) + F.col("cell_x") % 2).cast("int").alias(b) for i, b in enumerate(BANDS)]
        ts = F.lit(FIRST + timedelta(days=day)).cast("timestamp_ntz").alias("ts")
        name = F.lit(scene).alias("scene_id")
        return (
            cells.select(name, ts, F.lit("T").alias("mgrs_tile"), "cell_x", "cell_y", *dn),
            cells.select(name, ts, "cell_x", "cell_y", F.lit(score).alias("cs_cdf")),
        )

    scenes = [pixels("o1", 1, 1000, 0.6), pixels("o2", 4, 3000, 0.9), pixels("o3", 10, 2000, 0.59)]
    optical, cloud = scenes[0]
    for more_optical, more_cloud in scenes[1:]:
        optical, cloud = optical.unionByName(more_optical), cloud.unionByName(more_cloud)
    passes = [
        F.struct(F.lit(s["scene_id"]).alias("scene_id"), F.lit(s["ts"]).cast("timestamp_ntz").alias("ts"))
        for s in inputs.sar_scenes.collect()
    ]
    radar = cells.withColumn("s", F.explode(F.array(*passes))).select("s.*", "cell_x", "cell_y").select(
        "scene_id", "ts", "cell_x", "cell_y",
        F.when(F.col("scene_id") == "r1", -10.0).otherwise(-12.0).alias("vv"),
        F.lit(-18.0).alias("vh"), F.lit(38.0).alias("angle"),
    )
    inputs = Inputs(et, optical, cloud, inputs.sar_scenes, radar, inputs.met_hourly, inputs.rain_daily)
    return inputs, places, stations, grids


@pytest.fixture(scope="module")
def case(resolved):
    return resolved[:2]


def test_supports_skip_the_sea_cell(case):
    _, places = case
    sites = {r["station_id"]: r for r in places.sites.collect()}
    assert sites["a"]["modis_pixel_id"] == sites["b"]["modis_pixel_id"] != sites["c"]["modis_pixel_id"]
    assert {r["met_x"] for r in sites.values()} <= {1049, 1051}
    assert all(0 < r["era5_sampling_distance_m"] < 50_000 for r in sites.values())


def test_availability_flags_both_periods(case):
    inputs, places = case
    rows = availability(inputs, places, CONFIG).collect()
    assert len(rows) == 6
    for row in rows:
        first = row["period_start"] == "2021-01-01"
        assert (row["s2_valid"], row["s1_valid"], row["valid_observation"]) == (int(first), 1, int(first))
        assert row["s2_union_coverage_pct"] == (100.0 if first else 0.0)
        assert row["s2_dates"] == ("2021-01-02;2021-01-05" if first else "2021-01-11")
        assert row["s1_products_total"] == (2 if first else 1)
        assert row["ET_mm_period"] == pytest.approx(16.0) and row["ET_mm_day"] == pytest.approx(2.0)
    assert {r["period_end"] for r in rows} == {"2021-01-08", "2021-01-16"}


@pytest.fixture(scope="module")
def tables(case):
    inputs, places = case
    return build_training_tables(inputs, places, CONFIG)


def test_output_contract(tables):
    assert tables.all.columns == schemas.OUTPUT_SCHEMA.names and len(tables.all.columns) == 83
    assert [f.dataType for f in tables.all.schema] == [f.dataType for f in schemas.OUTPUT_SCHEMA]


def test_training_rows(tables):
    rows = tables.all.collect()
    assert len(rows) == 6 and all(r["stats_complete"] == 1 for r in rows)
    for row in rows:
        assert row["missing_stats_count"] == 0 and row["meteo_complete"] == 1
        # Two clear days tie; the earlier one (base 1000, plus 0 or 1) wins.
        assert 0.1000 <= row["Blue_mean"] <= 0.1001
        assert row["Green_mean"] == pytest.approx(row["Blue_mean"] + 0.01)
        assert 0.00004 < row["Blue_stdDev"] <= 0.00005
        assert row["VV_dB_mean"] == pytest.approx(-11.0) and row["VV_dB_stdDev"] == pytest.approx(0.0)
        assert row["VV_minus_VH_dB_mean"] == pytest.approx(7.0)
        assert row["Precip_prev30d_mm"] == pytest.approx(45.0)
        assert row["Precip_period_mm"] == pytest.approx(12.0)
        assert row["SolarRad_MJ_m2_day"] == pytest.approx(24.0)
        assert (row["s1_pass"], row["s1_relative_orbit"]) == ("ASCENDING", 77)
    shared = [r["Blue_mean"] for r in rows if r["scale"] == "footprint" and r["station_id"] in "ab"]
    assert len(shared) == 2 and shared[0] == shared[1]
    assert tables.footprint.count() == tables.local.count() == 3


def test_missing_statistics_leave_the_final_table(spark, case):
    inputs, places = case
    gap = Inputs(**{**inputs.__dict__, "sar_pixels": inputs.sar_pixels.withColumn("angle", F.lit(None).cast("double"))})
    found = build_training_tables(gap, places, CONFIG)
    row = found.all.head()
    assert (row["Angle_deg_mean"], row["missing_stats_count"], row["stats_complete"]) == (-9999.0, 2, 0)
    assert found.final.count() == 0
    with pytest.raises(ValueError, match="empty"):
        sinks.check_output(found.final)


def test_csv_round_trip(spark, tables, tmp_path):
    path = str(tmp_path / "csv")
    sinks.write_csv(tables.final, path)
    back = sinks.read_csv(spark, path)
    assert back.columns == schemas.OUTPUT_SCHEMA.names
    assert sorted(map(str, back.collect())) == sorted(map(str, tables.final.collect()))


def test_partitions_resume(spark, case, tmp_path):
    inputs, places = case
    root = str(tmp_path / "out")
    work = with_quarters(places.sites.select("station_id"), F.lit(CONFIG.start), F.lit(CONFIG.end))
    assert sinks.pending_partitions(spark, work, root).count() == 3

    part = work.filter("station_id <> 'c'")
    sinks.write_partitions(build_training_tables(inputs, places, CONFIG, part).final, part, root)
    left = sinks.pending_partitions(spark, work, root)
    assert [r["station_id"] for r in left.collect()] == ["c"]
    assert sinks.read_partitions(spark, root).count() == 4

    sinks.write_partitions(build_training_tables(inputs, places, CONFIG, left).final, left, root)
    assert sinks.pending_partitions(spark, work, root).isEmpty()
    # Repeating a partition replaces it.
    sinks.write_partitions(build_training_tables(inputs, places, CONFIG, part).final, part, root)
    merged = sinks.read_partitions(spark, root)
    assert sinks.check_output(merged) == {
        "total_rows": 6, "footprint_rows": 3, "local_60m_rows": 3, "other_rows": 0
    }
    with pytest.raises(ValueError, match="local rows"):
        sinks.check_output(merged.filter("not (scale = 'local_60m' and station_id = 'a')"))
    assert sinks.check_output(merged.filter("scale = 'footprint'"), strict=False)["footprint_rows"] == 3
    with pytest.raises(ValueError, match="unexpected"):
        sinks.check_output(merged.withColumn("scale", F.lit("odd")))


def test_a_rerun_without_rows_replaces_the_old_ones(spark, tables, tmp_path):
    root = str(tmp_path / "out")
    rows = tables.final
    work = sinks.with_partition(rows).select("station_id", "year", "quarter").distinct()
    sinks.write_partitions(rows, work, root)
    assert sinks.read_partitions(spark, root).count() == rows.count()
    sinks.write_partitions(rows.filter("station_id <> 'a'"), work, root)
    left = sinks.read_partitions(spark, root)
    assert left.count() == rows.filter("station_id <> 'a'").count() > 0
    assert left.filter("station_id = 'a'").isEmpty()
    assert sinks.pending_partitions(spark, work, root).isEmpty()


def test_rows_outside_the_work_list_are_left_out(spark, tables, tmp_path):
    root = str(tmp_path / "out")
    rows = tables.final
    work = sinks.with_partition(rows).select("station_id", "year", "quarter").distinct()
    part = work.filter("station_id = 'a'")
    sinks.write_partitions(rows, part, root)
    assert {r["station_id"] for r in sinks.read_partitions(spark, root).collect()} == {"a"}
    assert sinks.pending_partitions(spark, work, root).count() == work.count() - part.count()


def test_partitions_before_the_first_run_are_empty(spark, tables, tmp_path):
    root = str(tmp_path / "none")
    assert sinks.read_partitions(spark, root).isEmpty()
    with pytest.raises(ValueError, match="empty"):
        sinks.check_output(sinks.read_partitions(spark, root))
    work = sinks.with_partition(tables.final).select("station_id", "year", "quarter").distinct()
    sinks.write_partitions(tables.final.limit(0), work, root)
    assert sinks.read_partitions(spark, root).isEmpty()
    assert sinks.pending_partitions(spark, work, root).isEmpty()


def exported(spark, path):
    return sorted(map(str, sinks.read_csv(spark, path).collect()))


def test_a_failed_export_keeps_the_old_one(spark, tables, tmp_path, monkeypatch):
    path = str(tmp_path / "csv")
    sinks.write_csv(tables.final, path)
    before = exported(spark, path)
    broken = tables.final.withColumn("station", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_csv(broken, path)
    assert exported(spark, path) == before

    half = tables.final.filter("scale = 'footprint'")

    def dies(*_):
        raise OSError("died")

    # Between the new folder and the pointer: the old one stays current.
    with monkeypatch.context() as patched:
        patched.setattr(publication, "_point", dies)
        with pytest.raises(OSError):
            sinks.write_csv(half, path)
    assert exported(spark, path) == before
    # Between the pointer and the removal of older versions: the new one is current.
    with monkeypatch.context() as patched:
        patched.setattr(publication, "remove", dies)
        with pytest.raises(OSError):
            sinks.write_csv(half, path)
    assert len(exported(spark, path)) == half.count() < len(before)
    # The next export removes what failures left, and keeps one former version.
    sinks.write_csv(tables.final, path)
    assert exported(spark, path) == before
    assert len(publication.history(spark, path)) == len(publication.folders(spark, path)) == 2


def test_a_reader_of_the_former_version_is_not_cut_off(spark, tables, tmp_path):
    path = str(tmp_path / "csv")
    sinks.write_csv(tables.final, path)
    began = sinks.read_csv(spark, path)
    sinks.write_csv(tables.final.limit(0), path)
    assert began.count() == tables.final.count() and sinks.read_csv(spark, path).isEmpty()


def data_files(folder):
    return [p for p in folder.rglob("*.parquet")]


def test_compaction_keeps_the_rows_and_removes_the_rest(spark, tables, tmp_path, monkeypatch):
    root = tmp_path / "out"
    rows = tables.final
    work = sinks.with_partition(rows).select("station_id", "year", "quarter").distinct()
    assert sinks.compact(spark, str(root)) == 0
    for station in ("a", "b", "c", "a"):
        part = work.filter(F.col("station_id") == station)
        sinks.write_partitions(rows, part, str(root))
    sinks.write_partitions(rows.limit(0), work.filter("station_id = 'b'"), str(root))

    def live():
        return sorted(map(str, sinks.read_partitions(spark, str(root)).collect()))

    before = live()
    assert before == sorted(map(str, rows.filter("station_id <> 'b'").collect()))
    many = len(data_files(root / "rows"))

    def dies(*_):
        raise OSError("died")

    for step in ("publish", "remove"):
        with monkeypatch.context() as patched:
            patched.setattr(sinks, step, dies)
            with pytest.raises(OSError):
                sinks.compact(spark, str(root))
        assert live() == before
        assert sinks.pending_partitions(spark, work, str(root)).isEmpty()
    assert sinks.compact(spark, str(root)) >= 5
    assert live() == before
    assert len(data_files(root / "rows")) < many and len(publication.folders(spark, f"{root}/rows")) == 1
    assert sinks.compact(spark, str(root)) == 0
    # Runs go on as before: a new one replaces a partition, and is compacted again.
    sinks.write_partitions(rows, work.filter("station_id = 'b'"), str(root))
    assert live() == sorted(map(str, rows.collect()))
    assert sinks.compact(spark, str(root)) == 2
    assert live() == sorted(map(str, rows.collect()))


def test_a_work_list_gives_its_slice(spark, case, tables):
    inputs, places = case
    work = sinks.with_partition(tables.all).select("station_id", "year", "quarter").distinct()
    part = work.filter("station_id = 'a'")
    found = build_training_tables(inputs, places, CONFIG, part).all
    expected = tables.all.filter("station_id = 'a'")
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    near = of_stations(places, part)
    assert {r["station_id"] for r in near.sites.collect()} == {"a"}
    assert near.bridge.count() < places.bridge.count()
    dates = spark.createDataFrame([(CONFIG.start,)], "period_start date")
    assert window_of(dates, CONFIG).start == CONFIG.start
    assert window_of(dates, CONFIG).end <= CONFIG.end
    assert window_of(dates.limit(0), CONFIG) == CONFIG


def test_plans_have_no_nested_loops(case, tables):
    inputs, places = case
    for frame in (availability(inputs, places, CONFIG), tables.all):
        text = plan_text(frame)
        assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_scan_filters_reach_the_files(spark, case, tmp_path):
    inputs, _ = case
    path = str(tmp_path / "optical")
    inputs.optical_pixels.write.parquet(path)
    stored = scans.read_table(spark, path, schemas.OPTICAL_PIXELS)
    text = plan_text(scans.scan_optical(stored, CONFIG, ["b2"]).select("scene_id", "b2"))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text
    assert "ReadSchema: struct<scene_id:string,ts:timestamp_ntz,b2:int>" in text


def test_the_batch_job(spark, resolved, tables, tmp_path):
    inputs, _, stations, grids = resolved
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    stored = {**inputs.__dict__, "stations": stations, "grids": grids}
    for name, frame in stored.items():
        frame.write.parquet(f"{source}/{name}")
    counts = job.run(spark, source, target, CONFIG)
    assert counts == {"total_rows": 6, "footprint_rows": 3, "local_60m_rows": 3, "other_rows": 0}
    export = f"{target}/{CONFIG.output_name}"
    first = sorted(map(str, sinks.read_csv(spark, export).collect()))
    assert len(first) == 6
    # Nothing is pending now; the export stays the same.
    assert job.run(spark, source, target, CONFIG) == counts
    assert sorted(map(str, sinks.read_csv(spark, export).collect())) == first


def test_repeated_pixels_stop_a_run_where_they_are_read(spark, case):
    inputs, places = case
    footprint = places.bridge.filter("scale = 'footprint'").select("cell_x", "cell_y").limit(1)
    extra = inputs.sar_pixels.filter("scene_id = 'r1'").join(footprint, ["cell_x", "cell_y"])
    twice = inputs.sar_pixels.unionByName(extra)
    with pytest.raises(Exception, match=r"sar_pixels holds \d+ rows of \d+ cells"):
        availability(replace(inputs, sar_pixels=twice), places, CONFIG).collect()
    # Beside the window or the geometries a repeated pixel harms nothing and is not looked for.
    far = extra.withColumn("cell_x", F.col("cell_x") + 10_000_000)
    kept = replace(inputs, sar_pixels=inputs.sar_pixels.unionByName(far).unionByName(far))
    assert availability(kept, places, CONFIG).count() == 6

    et = replace(inputs, et_pixels=inputs.et_pixels.unionByName(inputs.et_pixels.limit(1)))
    with pytest.raises(Exception, match="et_pixels holds 2 rows"):
        availability(et, places, CONFIG).collect()


def test_the_job_checks_no_whole_pixel_table(resolved, case):
    inputs, _, stations, _ = resolved
    broken = inputs.sar_pixels.withColumn("ts", F.raise_error(F.lit("read")).cast("timestamp_ntz"))
    job.check_inputs(stations, replace(inputs, sar_pixels=broken), CONFIG)
    again = inputs.sar_scenes.unionByName(inputs.sar_scenes.limit(1))
    with pytest.raises(ValueError, match="sar_scenes holds 2 rows"):
        job.check_inputs(stations, replace(inputs, sar_scenes=again), CONFIG)


PIXEL_TABLES = ["optical_pixels", "cloud_pixels", "sar_pixels"]


def test_a_job_on_stored_pixels_prunes_all_three_tables(spark, resolved, case, tables, tmp_path):
    inputs, places, stations, grids = resolved
    source = str(tmp_path / "in")
    far = {
        name: getattr(inputs, name).withColumn("cell_x", F.col("cell_x") + 100_000) for name in PIXEL_TABLES
    }
    other = {
        name: getattr(inputs, name).withColumn("ts", F.expr("ts - interval 90 days")) for name in PIXEL_TABLES
    }
    for name in PIXEL_TABLES:
        every = getattr(inputs, name).unionByName(far[name]).unionByName(other[name])
        layout.write_pixels(every, f"{source}/{name}")
    rest = {k: v for k, v in inputs.__dict__.items() if k not in PIXEL_TABLES}
    for name, frame in {**rest, "stations": stations, "grids": grids}.items():
        frame.write.parquet(f"{source}/{name}")

    # Else the planner's text cuts long lists of filters.
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    stored = job.read_inputs(spark, source)
    footprints = footprint_cells_of(places.bridge)
    bounds, found = bounds_of(footprints), periods_of(stored, CONFIG)
    for rows in (
        optical_rows(stored, bounds, found, CONFIG),
        bounds.near(scans.scan_cloud(stored.cloud_pixels, CONFIG)),
        radar_rows(stored, bounds, found, CONFIG),
    ):
        filters = [x for x in plan_text(rows).splitlines() if "PartitionFilters" in x and "tile_x" in x]
        assert any("month" in x and "dynamicpruning" in x for x in filters), filters
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    expected = sorted(map(str, tables.final.collect()))
    counts = job.run(spark, source, str(tmp_path / "out"), CONFIG, stations_per_batch=2)
    assert counts["total_rows"] == len(expected)
    merged = sinks.read_partitions(spark, str(tmp_path / "out/partitions"))
    assert sorted(map(str, merged.collect())) == expected


def as_rows(frame):
    return sorted(map(str, frame.collect()))


def test_geometries_are_resolved_once(spark, resolved, case, tmp_path, monkeypatch):
    inputs, places, stations, grids = resolved
    store = GeometryStore(spark, str(tmp_path / "geometries"))
    first = resolve_places(stations.filter("station_id <> 'c'"), grids, inputs, CONFIG, store)
    assert {r["station_id"] for r in first.sites.collect()} == {"a", "b"}
    sampled = []
    real = geometry_store.footprint_cells

    def counted(cells, *rest):
        sampled.append(cells.count())
        return real(cells, *rest)

    monkeypatch.setattr(geometry_store, "footprint_cells", counted)
    # One station more: its footprint alone is sampled, and all is as without a store.
    found = resolve_places(stations, grids, inputs, CONFIG, store)
    assert sampled == [1]
    assert as_rows(found.sites.select(sorted(found.sites.columns))) == as_rows(
        places.sites.select(sorted(places.sites.columns))
    )
    assert as_rows(found.bridge) == as_rows(places.bridge)

    def never(*_):
        raise AssertionError("computed again")

    for name in ("footprint_cells", "local_cells", "nearest_cells"):
        monkeypatch.setattr(geometry_store, name, never)
    again = resolve_places(stations, grids, inputs, CONFIG, store)
    assert as_rows(again.bridge) == as_rows(places.bridge)
    # A moved station and another definition are new entries.
    moved = stations.withColumn("longitude", F.when(F.col("station_id") == "c", -74.9002).otherwise(F.col("longitude")))
    with pytest.raises(AssertionError, match="computed again"):
        resolve_places(moved, grids, inputs, CONFIG, store)
    with pytest.raises(AssertionError, match="computed again"):
        resolve_places(stations, grids, inputs, replace(CONFIG, footprint_samples=5), store)


def test_geometries_of_a_run_that_died_are_not_read(spark, tmp_path, monkeypatch):
    store = GeometryStore(spark, str(tmp_path / "geometries"))
    analysis = Grid("analysis", "utm18n", 0.0, 0.0, 20.0, 20.0, 20.0)
    stations = spark.createDataFrame(STATIONS, schemas.STATIONS)
    expected = as_rows(local_cells(stations, analysis, 30.0))
    real = GeometryStore._rows

    def dies(*_):
        raise OSError("died")

    # The rows are there, but no entry names them.
    monkeypatch.setattr(GeometryStore, "_rows", dies)
    with pytest.raises(OSError):
        store.boxes(stations, analysis, 30.0)
    monkeypatch.setattr(GeometryStore, "_rows", real)
    assert as_rows(store.boxes(stations, analysis, 30.0)) == expected
    assert as_rows(store.boxes(stations.filter("station_id = 'a'"), analysis, 30.0)) == as_rows(
        local_cells(stations.filter("station_id = 'a'"), analysis, 30.0)
    )


def test_inputs_from_the_catalog(spark, resolved, tmp_path):
    inputs, _, _, _ = resolved
    for name, frame in inputs.__dict__.items():
        if name != "rain_daily":
            frame.limit(1).write.parquet(str(tmp_path / name))
    inputs.rain_daily.createOrReplaceTempView("rain_of_the_test")
    found = job.read_inputs(spark, str(tmp_path), tables={"rain_daily": "rain_of_the_test"})
    assert found.rain_daily.count() == inputs.rain_daily.count() and found.met_hourly.count() == 1
    with pytest.raises(ValueError, match="unknown inputs: rain"):
        job.read_inputs(spark, str(tmp_path), tables={"rain": "x"})


def test_run_parameters_from_json():
    text = """{"start": "2021-01-01", "radar_orbit": 5, "optical_coverage": 0.9,
        "optical_grid": {"grid_id": "o", "kind": "utm18n", "origin_x": 0, "origin_y": 0,
                         "step_x": 10, "step_y": 10, "scale_m": 10},
        "analysis_grid": {"grid_id": "a", "kind": "utm18n", "origin_x": 0, "origin_y": 0,
                          "step_x": 20, "step_y": 20, "scale_m": 20}}"""
    config = job.read_config(text, start=None, end=date(2022, 5, 1))
    assert (config.start, config.end, config.radar_orbit) == (date(2021, 1, 1), date(2022, 5, 1), 5)
    assert config.optical_grid.step_x == 10 and config.optical_coverage == 0.9
    assert job.read_config("{}") == AnalysisConfig()
    with pytest.raises(ValueError, match="unknown run parameters: orbit"):
        job.read_config('{"orbit": 5}')


def run_log(spark, root):
    """Partitions by the time that they were recorded, one list a run."""
    rows = spark.read.parquet(f"{root}/done").orderBy("written_at", "station_id").collect()
    runs = {}
    for r in rows:
        runs.setdefault(r["run"], []).append((r["station_id"], r["year"], r["quarter"]))
    return list(runs.values())


def test_batches_are_bounded_and_complete(spark, case):
    _, places = case
    work = with_quarters(places.sites.select("station_id"), F.lit(date(2020, 11, 1)), F.lit(date(2021, 5, 1)))
    for size, groups in ((1, 3), (2, 2), (3, 1), (100, 1)):
        marked = batches.grouped(work, places.sites, size)
        listed = batches.batches_of(marked)
        assert len(listed) == 3 * groups and all(b.partitions <= size for b in listed)
        assert [(b.year, b.quarter) for b in listed] == sorted((b.year, b.quarter) for b in listed)
        found = [tuple(r) for b in listed for r in b.of(marked).collect()]
        assert len(found) == len(set(found))
        assert set(found) == {(r["station_id"], r["year"], r["quarter"]) for r in work.collect()}
    # The two stations of one ET cell are neighbours.
    pair = batches.grouped(work, places.sites, 2).groupBy("station_group").agg(F.collect_set("station_id").alias("s"))
    assert sorted(sorted(r["s"]) for r in pair.collect()) == [["a", "b"], ["c"]]
    with pytest.raises(ValueError, match="at least one"):
        batches.grouped(work, places.sites, 0)
    assert batches.batches_of(batches.grouped(work.limit(0), places.sites, 2)) == []


def test_a_failed_batch_costs_only_itself(spark, case, tables, tmp_path, monkeypatch):
    inputs, places = case
    root = str(tmp_path / "out")
    every = with_quarters(places.sites.select("station_id"), F.lit(CONFIG.start), F.lit(CONFIG.end))
    real, calls = batches.build_training_tables, []

    def second_fails(*arguments):
        calls.append(arguments)
        if len(calls) == 2:
            raise OSError("lost")
        return real(*arguments)

    monkeypatch.setattr(batches, "build_training_tables", second_fails)
    work = sinks.pending_partitions(spark, every, root)
    with pytest.raises(batches.BatchesFailed, match="1 batches failed, 1 are recorded, 1 were not tried"):
        batches.run_pending(inputs, places, CONFIG, work, root, 1)
    assert len(run_log(spark, root)) == 1 and len(calls) == 2

    seen = []
    left = sinks.pending_partitions(spark, every, root)
    assert left.count() == 2
    done = batches.run_pending(inputs, places, CONFIG, left, root, 1, finished=lambda b, s: seen.append(b))
    assert done == len(seen) == 2 and len(calls) == 4
    assert len(run_log(spark, root)) == 3 and all(len(p) == 1 for p in run_log(spark, root))
    assert sinks.pending_partitions(spark, every, root).isEmpty()
    merged = sorted(map(str, sinks.read_partitions(spark, root).collect()))
    assert merged == sorted(map(str, tables.final.collect()))
    assert batches.run_pending(inputs, places, CONFIG, left.limit(0), root, 1) == 0


def test_allowed_failures_let_the_other_batches_end(spark, case, tmp_path, monkeypatch):
    inputs, places = case
    root = str(tmp_path / "out")
    work = with_quarters(places.sites.select("station_id"), F.lit(CONFIG.start), F.lit(CONFIG.end))
    real = batches.build_training_tables

    def b_fails(inputs, places, config, part, periods):
        if not part.filter("station_id = 'b'").isEmpty():
            raise OSError("lost")
        return real(inputs, places, config, part, periods)

    monkeypatch.setattr(batches, "build_training_tables", b_fails)
    with pytest.raises(batches.BatchesFailed, match="2 are recorded, 0 were not tried") as caught:
        batches.run_pending(inputs, places, CONFIG, work, root, 1, failures_allowed=1)
    assert [f.batch.partitions for f in caught.value.failures] == [1]
    assert [r["station_id"] for r in sinks.pending_partitions(spark, work, root).collect()] == ["b"]


def test_a_batch_leaves_no_intermediate_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda _: str(tmp_path))
    kept = storage.written(spark.range(3), "outer")
    with pytest.raises(OSError), storage.scope(spark):
        storage.written(spark.range(4), "inner")
        with storage.scope(spark):
            storage.written(spark.range(5), "innermost")
        assert sorted(p.name.split("-")[0] for p in (tmp_path / "terraloom").iterdir()) == ["inner", "outer"]
        raise OSError("lost")
    assert [p.name.split("-")[0] for p in (tmp_path / "terraloom").iterdir()] == ["outer"]
    assert kept.count() == 3
