"""A work list pushed down to sites, bridge, composites and scan window."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.config import AnalysisConfig
from terraloom.functions.calendar import period_end, quarter_label
from terraloom.plans.inputs import Places


def of_stations(places: Places, work: DataFrame) -> Places:
    """Sites of the listed stations, and the geometries of those sites."""
    sites = places.sites.join(work.select("station_id").distinct(), "station_id", "left_semi")
    owners = sites.select(
        F.explode(
            F.array(
                F.struct(F.col("geom_id").alias("geom_id"), F.lit("footprint").alias("scale")),
                F.struct(F.col("station_id").alias("geom_id"), F.lit("local_60m").alias("scale")),
            )
        ).alias("g")
    ).select("g.*")
    bridge = places.bridge.join(owners.distinct(), ["geom_id", "scale"], "left_semi")
    return replace(places, sites=sites, bridge=bridge)


def of_quarters(periods: DataFrame, work: DataFrame) -> DataFrame:
    """Composites that start in a listed quarter."""
    start = F.col("period_start")
    keyed = periods.withColumns({"year": F.year(start), "quarter": quarter_label(start)})
    listed = work.select("year", "quarter").distinct()
    return keyed.join(listed, ["year", "quarter"], "left_semi").select("period_start")


def window_of(periods: DataFrame, config: AnalysisConfig) -> AnalysisConfig:
    """The window cut to the composites: one row with its two dates reaches the driver."""
    start = F.col("period_start")
    span = periods.agg(F.min(start).alias("first"), F.max(period_end(start)).alias("last")).head()
    if span["first"] is None:
        return config
    return replace(config, start=max(config.start, span["first"]), end=min(config.end, span["last"]))
