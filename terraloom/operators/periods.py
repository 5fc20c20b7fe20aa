"""Assignment of dated rows to composite periods.

A range predicate would plan as a nested-loop join. Periods are whole days, so each period is
spread over its days and the join becomes a hash join on the day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions.calendar import number_days, period_end


def composite_periods(et_pixels: DataFrame) -> DataFrame:
    """The distinct composites that the ET table holds: at most one per day of the window."""
    return et_pixels.select("period_start").distinct()


def with_bounds(periods: DataFrame) -> DataFrame:
    start = F.col("period_start")
    return periods.withColumns({"period_end": period_end(start), "number_days": number_days(start)})


def period_days(periods: DataFrame) -> DataFrame:
    """One row per period and day. At most 8 rows per calendar day of the window."""
    start = F.col("period_start")
    return periods.select(
        "period_start", F.explode(F.sequence(start, F.date_sub(period_end(start), 1))).alias("dd")
    )


def rain_days(periods: DataFrame, lookback: int) -> DataFrame:
    """Days of each period and of the `lookback` days before it, told apart by `in_period`."""
    start = F.col("period_start")
    day = F.explode(F.sequence(F.date_sub(start, lookback), F.date_sub(period_end(start), 1)))
    spread = periods.select("period_start", day.alias("dd"))
    return spread.withColumn("in_period", F.col("dd") >= start)


def assign_period(rows: DataFrame, instant: str, periods: DataFrame) -> DataFrame:
    """Add `dd` (the date of `instant`) and `period_start`; rows outside every period drop out.

    The broadcast side has a proven bound: its rows are counted in calendar days, never in data.
    """
    dated = rows.withColumn("dd", F.to_date(F.col(instant)))
    return dated.join(F.broadcast(period_days(periods)), "dd")
