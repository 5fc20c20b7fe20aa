"""Processing partitions: station x year x quarter, clipped to the window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTITION = ["station_id", "year", "quarter"]


def with_quarters(frame: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row per calendar quarter that [start, end) meets, with its clipped bounds."""
    first = F.trunc(start, "quarter")
    last = F.trunc(F.date_sub(end, 1), "quarter")
    opened = frame.withColumn(
        "__q", F.explode(F.sequence(first, last, F.expr("interval 3 months")))
    )
    return opened.withColumns(
        {
            "year": F.year("__q"),
            "quarter": F.concat(F.lit("Q"), F.quarter("__q").cast("string")),
            "quarter_start": F.greatest(F.col("__q"), start),
            "quarter_end": F.least(F.add_months("__q", 3), end),
        }
    ).drop("__q")


def pending(work: DataFrame, done: DataFrame) -> DataFrame:
    """Partitions of the work list that are not done yet."""
    return work.join(done.select(*PARTITION), PARTITION, "left_anti")
