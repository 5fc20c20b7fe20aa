"""Session settings that the plans are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
SETTINGS = {
    # Dates and timestamps without zone are used throughout; UTC keeps string casts predictable.
    "spark.sql.session.timeZone": "UTC",
    # Runtime plans: merge small partitions, split skewed join partitions, switch joins by size.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Pixel tables dealt or bucketed by scene join on scene and cell without a shuffle.
    CO_PARTITION: "false",
    # A shuffled hash join replaces a sort-merge join only where every partition's measured build
    # side stays below this size.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
}


def configured(builder: SparkSession.Builder, shuffle_partitions: int) -> SparkSession.Builder:
    """Apply the settings. A cluster wants shuffle partitions of some 100-200 MB each."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
