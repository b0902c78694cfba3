"""Exact money, shares, bands and gaps.

Money is summed as whole cents: long arithmetic stays in generated code, where a wide decimal would
allocate per row. Results turn back into decimals after the aggregation.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from outletscope.constants import (
    BAND_HIGH,
    BAND_HIGH_NAME,
    BAND_LOW,
    BAND_LOW_NAME,
    QUOTA_FIRST,
    QUOTA_STEP,
    SHARE_LIMIT,
)


def integer_div(a: Column, b: Column) -> Column:
    """Whole-number division towards zero."""
    return F.call_function("div", a, b)


def to_cents(price: Column) -> Column:
    return (price * 100).cast("bigint")


def from_cents(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("decimal(20,2)")


def sum_or_zero(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0).cast("bigint"))


def share_percent(part: Column, whole: Column) -> Column:
    """100 part / whole to two decimals, half away from zero; 0 where there is nothing to share.

    Wide enough for any two amounts; ``share_fits`` tells whether it is one to report.
    """
    ratio = F.round(F.try_divide(part * 100, whole), 2)
    return F.coalesce(ratio, F.lit(0)).cast("decimal(28,2)")


def share_fits(share: Column) -> Column:
    """Whether a share has at most eight digits before the point."""
    return F.abs(share) < F.lit(SHARE_LIMIT)


def truncated_share(part: Column, whole: Column) -> Column:
    """100 part / whole of two counts, cut (not rounded) after two decimals; 0 for an empty whole."""
    hundredths = integer_div(part * 10000, F.nullif(whole, F.lit(0)))
    return F.coalesce(from_cents(hundredths), F.lit(0)).cast("decimal(20,2)")


def money_ratio(part: Column, whole: Column) -> Column:
    """Ratio of two amounts in cents as a double, NULL for a zero whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def share_band(share: Column, low: float = BAND_LOW, high: float = BAND_HIGH) -> Column:
    """Style name of a share; the limits themselves carry none."""
    return F.when(share < low, BAND_LOW_NAME).when(share > high, BAND_HIGH_NAME).otherwise("")


def gap_to_target(share: Column, part: Column, whole: Column, target: float) -> Column:
    """Amount missing for ``part`` to reach ``target`` percent of ``whole``; 0 once the share is there."""
    missing = whole * F.lit(Decimal(str(target)) / 100) - part
    return F.when(share < target, missing).otherwise(F.lit(0)).cast("decimal(24,4)")


def allowed_outlets(population: Column, first: int = QUOTA_FIRST, step: int = QUOTA_STEP) -> Column:
    """Outlets a population allows: one from ``first`` on, one more for each full ``step``."""
    extra = integer_div(population - first, F.lit(step))
    return F.when(population < first, F.lit(0).cast("bigint")).otherwise(extra + 1)
