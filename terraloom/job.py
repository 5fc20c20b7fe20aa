"""The batch job: input tables -> pending partitions -> rows -> one CSV export -> checks.

usage: spark-submit terraloom/job.py INPUT_DIR OUTPUT_DIR [--config FILE] [--start DAY] [--end DAY]
       [--format parquet] [--stations-per-batch N] [--failures-allowed N] [--compact]
       [--table INPUT=TABLE ...]

INPUT_DIR holds stations, grids, et_pixels, optical_pixels, cloud_pixels, sar_scenes, sar_pixels,
met_hourly and rain_daily in the schemas of `terraloom.schemas`; pixel tables may be stored by month
and tile or in buckets (`sources.layout`), the latter named by --table. OUTPUT_DIR gets the partitions and their ledger, resolved geometries, and
the export under the configured name. FILE is a JSON object of `AnalysisConfig` fields. Pending work
is done in batches, each recorded as it ends; a repeated run does only what is pending.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import fields
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom import schemas
from terraloom.config import AnalysisConfig
from terraloom.operators.storage import scope, written
from terraloom.operators.worklist import with_quarters
from terraloom.plans.batches import run_pending
from terraloom.plans.geometry_store import GeometryStore
from terraloom.plans.inputs import Inputs
from terraloom.plans.places import resolve_places
from terraloom.session import configured
from terraloom.sources import sinks
from terraloom.sources.grids import Grid
from terraloom.sources.scans import read_table, scan_stations, select_radar_scenes


def read_inputs(
    spark: SparkSession, folder: str, fmt: str = "parquet", tables: dict[str, str] | None = None
) -> Inputs:
    """Input tables from `folder`, or from the catalog where `tables` names one for an input."""
    tables = tables or {}
    unknown = sorted(set(tables) - set(Inputs.__dataclass_fields__))
    if unknown:
        raise ValueError(f"unknown inputs: {', '.join(unknown)}")
    return Inputs(
        **{
            name: spark.table(tables[name])
            if name in tables
            else read_table(spark, f"{folder}/{name}", getattr(schemas, name.upper()), fmt)
            for name in Inputs.__dataclass_fields__
        }
    )


def require_unique(frame: DataFrame, keys: list[str], name: str) -> None:
    """Raise if two rows share the keys; one example reaches the driver."""
    twice = frame.groupBy(*keys).count().filter("count > 1").head()
    if twice is not None:
        raise ValueError(f"{name} holds {twice['count']} rows of {twice.asDict()}")


def check_inputs(stations: DataFrame, inputs: Inputs, config: AnalysisConfig) -> None:
    """Keys of the small tables that the plans take as unique.

    Pixels are checked where the plans read and group them anyway: `radar.once_per_scene` and
    `observations.single` raise there.
    """
    require_unique(scan_stations(stations), ["station_id"], "stations")
    require_unique(select_radar_scenes(inputs.sar_scenes, config), ["scene_id"], "sar_scenes")


def run(
    spark: SparkSession,
    source: str,
    target: str,
    config: AnalysisConfig,
    fmt: str = "parquet",
    stations_per_batch: int = 500,
    failures_allowed: int = 0,
    tables: dict[str, str] | None = None,
) -> dict[str, int]:
    """Do the pending partitions batch by batch, export all of them, return the checked counts.

    A run that fails keeps every batch that it recorded and exports nothing.
    """
    stations = read_table(spark, f"{source}/stations", schemas.STATIONS, fmt)
    root = f"{target}/partitions"
    every = with_quarters(
        scan_stations(stations).select("station_id"), F.lit(config.start), F.lit(config.end)
    )
    with scope(spark):
        pending = written(sinks.pending_partitions(spark, every, root), "pending")
        if not pending.isEmpty():
            grids = read_table(spark, f"{source}/grids", schemas.GRIDS, fmt)
            inputs = read_inputs(spark, source, fmt, tables)
            check_inputs(stations, inputs, config)
            store = GeometryStore(spark, f"{target}/geometries")
            places = resolve_places(stations, grids, inputs, config, store)
            run_pending(
                inputs, places, config, pending, root, stations_per_batch, failures_allowed
            )
    table = sinks.read_partitions(spark, root)
    counts = sinks.check_output(table)
    sinks.write_csv(table, f"{target}/{config.output_name}")
    return counts


def read_config(text: str, **given: object) -> AnalysisConfig:
    """Run parameters from a JSON object of `AnalysisConfig` fields; `given` ones win.

    Dates are ISO days, grids are objects of `Grid` fields. An unknown name is an error.
    """
    found = json.loads(text)
    unknown = sorted(set(found) - {f.name for f in fields(AnalysisConfig)})
    if unknown:
        raise ValueError(f"unknown run parameters: {', '.join(unknown)}")
    for name in ("start", "end"):
        if name in found:
            found[name] = date.fromisoformat(found[name])
    for name in ("optical_grid", "analysis_grid"):
        if found.get(name) is not None:
            found[name] = Grid(**found[name])
    return AnalysisConfig(**{**found, **{k: v for k, v in given.items() if v is not None}})


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--config", type=Path)
    parser.add_argument("--start", type=date.fromisoformat)
    parser.add_argument("--end", type=date.fromisoformat)
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--shuffle-partitions", type=int, default=2000)
    parser.add_argument("--stations-per-batch", type=int, default=500)
    parser.add_argument("--failures-allowed", type=int, default=0)
    parser.add_argument("--compact", action="store_true")
    parser.add_argument("--table", action="append", default=[], metavar="INPUT=TABLE")
    chosen = parser.parse_args(arguments)
    text = chosen.config.read_text() if chosen.config else "{}"
    config = read_config(text, start=chosen.start, end=chosen.end)
    spark = configured(SparkSession.builder.appName("terraloom"), chosen.shuffle_partitions).getOrCreate()
    counts = run(
        spark, chosen.source, chosen.target, config, chosen.format,
        chosen.stations_per_batch, chosen.failures_allowed,
        dict(pair.split("=", 1) for pair in chosen.table),
    )
    if chosen.compact:
        sinks.compact(spark, f"{chosen.target}/partitions")
    print(counts)


if __name__ == "__main__":
    main()
