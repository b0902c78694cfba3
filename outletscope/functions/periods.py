"""Month keys (``YYYYMM`` integers): column expressions, and the same arithmetic for job parameters."""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from outletscope.constants import MONTH_NAMES, SEND_DAY, TRAILING_MONTHS
from outletscope.functions.numbers import integer_div

# --- columns ----------------------------------------------------------------


def month_key(day: Column) -> Column:
    return (F.year(day) * 100 + F.month(day)).cast("int")


def month_index(key: Column) -> Column:
    """Months counted from year 0, so that month arithmetic needs no year wrap."""
    return integer_div(key, F.lit(100)) * 12 + key % 100 - 1


def month_of_index(index: Column) -> Column:
    return (integer_div(index, F.lit(12)) * 100 + index % 12 + 1).cast("int")


def shift_month(key: Column, months: int) -> Column:
    return month_of_index(month_index(key) + months)


def previous_month(day: Column, overflow: bool = False) -> Column:
    """Month key before ``day``.

    A day the previous month does not have is clamped to its last day; with ``overflow`` it runs on
    into the following month instead (31 March -> "31 February" -> 3 March).
    """
    if overflow:
        first = F.add_months(F.trunc(day, "MM"), -1)
        return month_key(F.date_add(first, F.dayofmonth(day) - 1))
    return month_key(F.add_months(day, -1))


def month_label(key: Column) -> Column:
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    year = integer_div(key, F.lit(100)).cast("string")
    return F.concat(F.element_at(names, (key % 100).cast("int")), F.lit(" "), year)


def next_business_day(day: Column, holidays: Iterable[date] = ()) -> Column:
    """``day`` itself, or the first later day that is neither a weekend day nor a holiday."""
    closed = sorted(set(holidays))
    days = F.sequence(day, F.date_add(day, longest_closed_run(closed)))

    def is_open(d: Column) -> Column:
        weekday = F.weekday(d) < 5
        return weekday & ~d.isin(closed) if closed else weekday

    return F.filter(days, is_open)[0]


def planned_day(key: Column, day: int = SEND_DAY) -> Column:
    return F.make_date(integer_div(key, F.lit(100)).cast("int"), (key % 100).cast("int"), F.lit(day))


def send_date(key: Column, day: int = SEND_DAY, holidays: Iterable[date] = ()) -> Column:
    """Send date of a month: the given day, rolled forward to a business day."""
    return next_business_day(planned_day(key, day), holidays)


# --- job parameters ---------------------------------------------------------


def longest_closed_run(holidays: Iterable[date]) -> int:
    """Length of the longest row of closed days: how far a roll forward can go at most."""
    closed = set(holidays)

    def is_closed(day: date) -> bool:
        return day.weekday() >= 5 or day in closed

    longest = 2
    for start in closed:
        while is_closed(start - timedelta(days=1)):
            start -= timedelta(days=1)
        end = start
        while is_closed(end):
            end += timedelta(days=1)
        longest = max(longest, (end - start).days)
    return longest


def previous_month_of(as_of: date, overflow: bool = False) -> int:
    year, month = (as_of.year, as_of.month - 1) if as_of.month > 1 else (as_of.year - 1, 12)
    if overflow and as_of.day > monthrange(year, month)[1]:
        year, month = as_of.year, as_of.month
    return year * 100 + month


def trailing_months(end: int, n: int = TRAILING_MONTHS) -> tuple[int, int]:
    """First and last key of the ``n`` months that end with ``end``."""
    first = end // 100 * 12 + end % 100 - 1 - (n - 1)
    return first // 12 * 100 + first % 12 + 1, end


def index_of_month(key: int) -> int:
    return key // 100 * 12 + key % 100 - 1


def since(start: int, end: int) -> tuple[int, int]:
    if end < start:
        raise ValueError(f"invalid period: {end} is earlier than {start}")
    return start, end


def month_start(key: int) -> date:
    return date(key // 100, key % 100, 1)


def month_after(key: int) -> date:
    """First day after the month."""
    return date(key // 100 + key % 100 // 12, key % 100 % 12 + 1, 1)
