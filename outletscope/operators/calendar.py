"""Calendar tables: month keys with their labels and windows, send dates."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outletscope.constants import SEND_DAY, TRAILING_MONTHS
from outletscope.functions.periods import month_label, next_business_day, planned_day, previous_month, send_date, shift_month


def month_keys(days: DataFrame) -> DataFrame:
    """For each ``day``: the month to report on, its label, and the key when the shift may overflow."""
    key = previous_month(F.col("day"))
    return (
        days.withColumn("previous", key)
        .withColumn("previous_overflow", previous_month(F.col("day"), overflow=True))
        .withColumn("label", month_label(F.col("previous")))
    )


def period_windows(months: DataFrame, since: int, n: int = TRAILING_MONTHS) -> DataFrame:
    """For each ``period``: the trailing window that ends with it, and whether ``since`` opens one."""
    return (
        months.withColumn("trailing_start", shift_month(F.col("period"), -(n - 1)))
        .withColumn("since_start", F.when(F.col("period") >= since, since))
        .withColumn("since_valid", F.col("period") >= since)
    )


def send_dates(months: DataFrame, holidays: Iterable[date], day: int = SEND_DAY) -> DataFrame:
    """For each ``period``: its send date."""
    return months.withColumn("send_date", send_date(F.col("period"), day, holidays))


def business_days(days: DataFrame, holidays: Iterable[date]) -> DataFrame:
    """For each ``day``: the business day it rolls forward to."""
    return days.withColumn("business_day", next_business_day(F.col("day"), holidays))


def business_calendar(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """``day``, ``is_open`` and ``business_day`` (itself or the next open one) of every day from the first ``day`` to the last.

    ``holidays`` is a table with a ``day``, of any length and with repeated or NULL days. The calendar runs on behind the
    last day, far enough for any row of closed days: L of them hold at most 2 L / 7 + 2 weekend days, so L is below
    1.4 times the holidays plus 3. It has a row per day of the range, whatever the size of the tables (a century has
    36,525), so its one ordered pass is a small one.
    """
    closed = holidays.select("day").filter(F.col("day").isNotNull()).distinct()
    reach = closed.agg(F.count("*").alias("holidays"))
    bounds = days.agg(F.min("day").alias("first"), F.max("day").alias("last")).filter(F.col("first").isNotNull())
    beyond = F.date_add("last", (reach.scalar() * 2 + 4).cast("int"))
    spread = bounds.withColumn("beyond", beyond).select("last", F.explode(F.sequence("first", "beyond")).alias("day"))
    marked = spread.join(closed.withColumn("is_holiday", F.lit(True)), "day", "left")
    is_open = (F.weekday("day") < 5) & F.col("is_holiday").isNull()
    from_here = W.orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, 0)
    following = F.last(F.when(F.col("is_open"), F.col("day")), ignorenulls=True).over(from_here)
    rolled = marked.withColumn("is_open", is_open).withColumn("business_day", following)
    return rolled.filter(F.col("day") <= F.col("last")).select("day", "is_open", "business_day")


def planned_days(months: DataFrame, day: int = SEND_DAY) -> DataFrame:
    """For each ``period``: the ``day`` its report is planned for."""
    return months.withColumn("day", planned_day(F.col("period"), day))


def rolled_forward(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """For each ``day``: the business day it rolls forward to, by a table of holidays; a NULL day has none."""
    return days.join(business_calendar(days, holidays).select("day", "business_day"), "day", "left")
