"""Scorecards of every month at once: windows of months over monthly sums.

The sales are read once, for all windows. They are summed to a row per key and month; a window's figures are then a
range frame over the number of the month, whatever the number of windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outletscope.constants import GROUP_PREFIXES, MOLECULE_RULES, TOTAL_NAME, TOTAL_SORT, TRAILING_MONTHS
from outletscope.functions.numbers import from_cents, share_percent, sum_or_zero, truncated_share
from outletscope.functions.periods import index_of_month, month_index, month_of_index, trailing_months
from outletscope.operators.joins import in_period, sell
from outletscope.operators.launches import MEASURES, launch_items
from outletscope.operators.molecules import Rules, molecule_items
from outletscope.sources.domain import Domain


def windowed(sums: DataFrame, keys: Sequence[str], measures: Sequence[str], last: int, n: int | None = TRAILING_MONTHS) -> DataFrame:
    """``keys``, ``period`` and the ``measures`` summed over the ``n`` months that end with it; all earlier months without ``n``.

    ``sums`` has a row per keys and period at most. There is a row for each month up to ``last`` whose window holds one of
    them: a month without sales of its own is filled in behind the one before it. A key's rows are no more than its months.
    """
    months = W.partitionBy(*keys).orderBy("month_no")
    until = [F.lit(index_of_month(last)), F.lead("month_no").over(months) - 1]
    if n is not None:
        until.append(F.col("month_no") + (n - 1))
    # least() passes over the NULL behind a key's last row
    spans = sums.withColumn("month_no", month_index(F.col("period"))).withColumn("until", F.least(*until))
    own = F.col("month") == F.col("month_no")
    filled = spans.withColumn("month", F.explode(F.sequence("month_no", "until"))).select(
        *keys, "month", *[F.when(own, F.col(m)).otherwise(0).alias(m) for m in measures]
    )
    frame = W.partitionBy(*keys).orderBy("month").rangeBetween(W.unboundedPreceding if n is None else 1 - n, 0)
    return filled.select(*keys, month_of_index(F.col("month")).alias("period"), *[F.sum(m).over(frame).alias(m) for m in measures])


def launch_windows(domain: Domain, focus_lab: str, first: int, last: int, n: int = TRAILING_MONTHS) -> DataFrame:
    """The launch quantities and share of each outlet and substance, for each window of ``n`` months that ends in ``first``
    to ``last`` and has sales of theirs."""
    start, _ = trailing_months(first, n)
    flags = {"focus_qty": "is_focus", "competitor_qty": "is_competitor", "originator_qty": "is_originator", "generic_qty": "is_generic"}
    sold = sell(in_period(domain.sales, start, last), launch_items(domain, focus_lab), "period")
    keys = ("outlet_id", "dci")
    sums = sold.groupBy(*keys, "period").agg(*[sum_or_zero(F.when(F.col(f), F.col("qty"))).alias(m) for m, f in flags.items()])
    found = windowed(sums, keys, list(flags), last, n).filter(F.col("period") >= first)
    share = truncated_share(F.col("focus_qty"), F.col("generic_qty")).alias("share")
    return found.select("outlet_id", "period", "dci", share, *MEASURES)


def molecule_windows(
    domain: Domain,
    focus_lab: str,
    first: int,
    last: int,
    n: int | None = TRAILING_MONTHS,
    rules: Rules = MOLECULE_RULES,
    prefixes: Sequence[str] = GROUP_PREFIXES,
) -> DataFrame:
    """The molecule figures and share of each outlet, and its total, for each window that ends in ``first`` to ``last`` and
    has sales of theirs: of ``n`` months, or without ``n`` of all months since ``first``."""
    start = first if n is None else trailing_months(first, n)[0]
    items = molecule_items(domain, focus_lab, sorted(rules), prefixes)
    sold = sell(in_period(domain.collection, start, last), items, "period")
    # every row counts in its molecule and in the total
    counted = sold.withColumn("sort_order", F.explode(F.array("sort_order", F.lit(TOTAL_SORT))))
    keys, value = ("outlet_id", "sort_order"), F.col("qty") * F.col("price_cents")
    sides = {"focus": F.col("is_focus"), "other": ~F.col("is_focus")}
    amounts = {"qty": F.col("qty"), "cents": value}
    sums = counted.groupBy(*keys, "period").agg(
        *[sum_or_zero(F.when(side, amount)).alias(f"{s}_{a}") for s, side in sides.items() for a, amount in amounts.items()]
    )
    measures = [f"{s}_{a}" for s in sides for a in amounts]
    found = windowed(sums, keys, measures, last, n).filter(F.col("period") >= first)
    names = F.create_map(*[F.lit(x) for r in sorted(rules) for x in (r.sort_order, r.display)], F.lit(TOTAL_SORT), F.lit(TOTAL_NAME))
    focus, other = from_cents(F.col("focus_cents")), from_cents(F.col("other_cents"))
    return found.select(
        "outlet_id",
        "period",
        names[F.col("sort_order")].alias("molecule"),
        "focus_qty",
        "other_qty",
        focus.alias("focus_value"),
        other.alias("other_value"),
        share_percent(focus, focus + other).alias("share"),
        "sort_order",
    )
