"""8-day composite calendar. Every expression is independent of the session time zone."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIOD_DAYS = 8
DAY_MILLIS = 86_400_000


def period_end(start: Column) -> Column:
    """Exclusive end: 8 days on, cut at the next 1 January."""
    next_year = F.make_date(F.year(start) + 1, F.lit(1), F.lit(1))
    return F.least(F.date_add(start, PERIOD_DAYS), next_year)


def number_days(start: Column) -> Column:
    return F.datediff(period_end(start), start)


def last_day(start: Column) -> Column:
    """Inclusive end, as shown in the output."""
    return F.date_sub(period_end(start), 1)


def epoch_millis(day: Column) -> Column:
    return F.unix_date(day).cast("bigint") * F.lit(DAY_MILLIS).cast("bigint")


def date_key(instant: Column) -> Column:
    return F.to_date(instant).cast("string")


def half_open(column: Column, start: date, end: date) -> Column:
    """start <= column < end."""
    return (column >= F.lit(start)) & (column < F.lit(end))


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"))
