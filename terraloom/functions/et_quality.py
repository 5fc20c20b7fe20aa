"""Evapotranspiration scaling and quality bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.functions.masks import flag

# Scale factor, valid stored range, no-flag code.
ET_SCALE = 0.1
ET_RANGE = (0, 32700)
NO_QUALITY_CODE = 255


def bits(word: Column, first: int, width: int) -> Column:
    mask = (1 << width) - 1
    return F.shiftright(word, first).bitwiseAND(F.lit(mask))


def cloud_code(qc: Column) -> Column:
    """Bits 5-7, or 255 where there is no quality word."""
    return F.coalesce(bits(qc, 5, 3), F.lit(NO_QUALITY_CODE))


def good_flag(dn: Column, qc: Column) -> Column:
    """Main algorithm, working detector, at most slight cloud, stored value in range."""
    return flag(
        (bits(qc, 0, 1) == 0)
        & (bits(qc, 2, 1) == 0)
        & (bits(qc, 5, 3) <= 1)
        & dn.between(*ET_RANGE)
    )


def et_period(dn: Column) -> Column:
    return dn * F.lit(ET_SCALE)


def et_per_day(dn: Column, days: Column) -> Column:
    return et_period(dn) / days
