"""Exact medians per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rank bracket around the middle, and the rank accuracy of the sketch that places it.
BRACKET = (0.499, 0.501)
ACCURACY = 20_000


def spread_medians(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Median of every column in `values` per `keys`, for groups that grow with the data; NULLs are
    ignored, an even count averages. Medians by ranks: count equal values, bracket the middle with a
    sketch, rank inside it.

    The counts are keyed by value, so one group spreads over all tasks; only the bracket, about
    0.2 % of a group's ranks, is ordered in one place. The bracket's counted lower edge makes the
    ranks exact whatever the sketch's error, which the bracket's width exceeds.
    """
    named = F.explode(
        F.array(
            *[
                F.struct(F.lit(v).alias("band"), F.col(v).cast("double").alias("value"))
                for v in values
            ]
        )
    )
    long = rows.select(*keys, named.alias("__s")).select(*keys, "__s.band", "__s.value")
    group = [*keys, "band"]
    counted = (
        long.filter(F.col("value").isNotNull())
        .groupBy(*group, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    brackets = long.groupBy(*group).agg(
        F.percentile_approx("value", list(BRACKET), ACCURACY).alias("edge"),
        F.count("value").alias("total"),
    )
    edged = counted.join(brackets, group)
    low, high = F.col("edge")[0], F.col("edge")[1]
    below = edged.groupBy(*group).agg(
        F.sum(F.when(F.col("value") < low, F.col("n")).otherwise(0)).alias("below")
    )
    running = Window.partitionBy(*group).orderBy("value")
    inside = (
        edged.filter((F.col("value") >= low) & (F.col("value") <= high))
        .join(below, group)
        .withColumn("upto", F.col("below") + F.sum("n").over(running))
    )
    lower_rank = F.floor((F.col("total") + 1) / 2)
    upper_rank = F.floor(F.col("total") / 2) + 1

    def at(rank):
        reached = (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
        return F.max(F.when(reached, F.col("value")))

    found = inside.groupBy(*group).agg(
        ((at(lower_rank) + at(upper_rank)) / 2).alias("median"), F.max("total").alias("total")
    )
    # A bracket that misses the middle would be an error of the sketch; it must not pass as NULL.
    missed = F.raise_error(F.lit("a median fell outside its bracket"))
    medians = found.withColumn(
        "median", F.when(F.col("median").isNull() & (F.col("total") > 0), missed).otherwise(F.col("median"))
    )
    pivoted = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("band") == v, F.col("median"))).alias(v) for v in values]
    )
    # Groups whose every value is NULL have no bracket; they still owe a row.
    groups = rows.select(*keys).distinct()
    same_key = reduce(lambda a, b: a & b, [groups[k].eqNullSafe(pivoted[k]) for k in keys])
    return groups.join(pivoted, same_key, "left").select(*[groups[k] for k in keys], *values)
