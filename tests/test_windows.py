"""Windows of every month, the business calendar, the committed report."""

from __future__ import annotations

import random
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from outletscope.operators import calendar, launches, molecules, windows
from outletscope.plans import artefact
from outletscope.plans import queries as q
from outletscope.sources import star, tables
from tests.tables import rows

DIR = "/root/testdata/sf0.01"


# --- windows


def month_keys(first, last):
    return [k for k in range(first, last + 1) if 1 <= k % 100 <= 12]


@pytest.mark.parametrize("n", [1, 3, 6, None])
def test_windows_of_random_sums(spark, n):
    """Gaps inside of a window, gaps longer than it, and the turn of the year, against sums month by month."""
    draw, months = random.Random(n), month_keys(199910, 200112)
    sums = {(k, m): draw.randint(-5, 5) for k in "abc" for m in draw.sample(months, draw.randint(1, 9))}
    frame = spark.createDataFrame([(k, m, v) for (k, m), v in sums.items()], "key STRING, period INT, qty BIGINT")
    expected = []
    for key in "abc":
        for i, end in enumerate(months):
            inside = [sums[key, m] for m in months[0 if n is None else max(0, i - n + 1) : i + 1] if (key, m) in sums]
            expected += [(key, end, sum(inside))] if inside else []
    assert rows(windows.windowed(frame, ["key"], ["qty"], months[-1], n)) == sorted(expected, key=repr)


def test_windows_of_nothing(spark):
    empty = spark.createDataFrame([], "key STRING, period INT, qty BIGINT")
    assert rows(windows.windowed(empty, ["key"], ["qty"], 200101)) == []


def test_each_window_equals_the_scorecard_of_its_months(spark):
    """Against the operators for one window; they show outlets and molecules without sales too."""
    first, last = q.trailing_months(q.MONTH, 6)
    domain = star.load_star(spark, DIR, first, q.END)
    found = windows.launch_windows(domain, q.LAB, q.MONTH, q.END).filter(F.col("period") == q.MONTH).drop("period")
    single = launches.launch_sales(domain, q.LAB, first, last).select(*found.columns)
    assert rows(found) == rows(single)
    columns = ["outlet_id", "molecule", "focus_qty", "other_qty", "focus_value", "other_value", "share", "sort_order"]
    card = molecules.molecule_scorecard(domain, q.LAB, q.SINCE, q.MONTH, star.RULES, star.PREFIXES).select(columns)
    since = windows.molecule_windows(domain, q.LAB, q.SINCE, q.END, None, star.RULES, star.PREFIXES)
    shown = rows(since.filter(F.col("period") == q.MONTH).select(columns))
    assert shown and set(shown) <= set(rows(card))
    assert all(r[2] == r[3] == 0 for r in set(rows(card)) - set(shown))


def test_windows_over_stored_months_are_the_same(spark, tmp_path):
    domain = star.load_star(spark, DIR, 199708, q.END)
    tables.write_monthly_sales(domain.sales, str(tmp_path / "sales"))
    stored = domain.replaced(sales=tables.read_monthly_sales(spark, str(tmp_path / "sales")))
    assert rows(windows.launch_windows(stored, q.LAB, q.START, q.END)) == rows(windows.launch_windows(domain, q.LAB, q.START, q.END))


@pytest.mark.parametrize("name", ["launch_windows", "molecule_windows", "molecule_since_windows"])
def test_windows_read_the_fact_once(spark, name):
    """One scan for all months, and one shuffle by key for the sums, the filled months and the frame."""
    plan = q.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_") == 1
    keys = "dci" if name == "launch_windows" else "sort_order"
    above = plan[: plan.rindex("Generate explode(sequence(month_no")]
    assert "Window" in above and "Exchange" not in above and "Exchange" in plan
    assert keys in plan


# --- business calendar


def plain_next(day, closed):
    while day.weekday() >= 5 or day in closed:
        day += timedelta(days=1)
    return day


@pytest.mark.parametrize("closed_days", [0, 11, 60])
def test_business_calendar(spark, closed_days):
    """Holidays at random, and a closed stretch that runs far beyond the last day."""
    draw, first = random.Random(closed_days), date(2024, 12, 20)
    closed = [first + timedelta(days=draw.randint(0, 90)) for _ in range(closed_days // 2)]
    closed += [date(2025, 2, 27) + timedelta(days=i) for i in range(closed_days // 2)]
    holidays = spark.createDataFrame([(d,) for d in [*closed, *closed[:3], None]], "day DATE")
    days = [first, date(2025, 1, 4), date(2025, 2, 28), None]
    frame = spark.createDataFrame([(d,) for d in days], "day DATE")
    spread = [first + timedelta(days=i) for i in range((date(2025, 2, 28) - first).days + 1)]
    found = calendar.business_calendar(frame, holidays)
    assert [tuple(r) for r in found.orderBy("day").collect()] == [(d, plain_next(d, closed) == d, plain_next(d, closed)) for d in spread]
    rolled = {r.day: r.business_day for r in calendar.rolled_forward(frame, holidays).collect()}
    assert rolled == {d: d and plain_next(d, closed) for d in days}


def test_calendar_of_no_days(spark):
    none = spark.createDataFrame([], "day DATE")
    assert rows(calendar.business_calendar(none, none)) == []
    assert rows(calendar.rolled_forward(spark.createDataFrame([(None,)], "day DATE"), none)) == [(None, None)]


def test_the_table_agrees_with_the_list(spark):
    """Send dates by the holiday table and by the list of holidays."""
    days = spark.createDataFrame([(m,) for m in month_keys(202501, 202512)], "period INT")
    listed = calendar.send_dates(days, star.HOLIDAYS_2025).select("period", "send_date")
    holidays = spark.createDataFrame([(d,) for d in star.HOLIDAYS_2025], "day DATE")
    by_table = calendar.rolled_forward(calendar.planned_days(days), holidays).select("period", "business_day")
    assert rows(by_table) == rows(listed)


# --- committed report


def month_rows(spark, period, *ids):
    return spark.createDataFrame([(i, period, [i, i]) for i in ids], "outlet_id BIGINT, period INT, cells ARRAY<BIGINT>")


def read(spark, path, period=None):
    return rows(artefact.read_report(spark, path, period), "outlet_id", "period")


def test_a_commit_switches_its_month(spark, tmp_path):
    path = str(tmp_path)
    artefact.commit_report(month_rows(spark, 199806, 1, 2), path, 199806)
    artefact.commit_report(month_rows(spark, 199807, 3), path, 199807)
    artefact.commit_report(month_rows(spark, 199806, 2, 5, 7), path, 199806)
    assert read(spark, path, 199806) == [(2, 199806), (5, 199806), (7, 199806)]
    assert read(spark, path) == [(2, 199806), (3, 199807), (5, 199806), (7, 199806)]
    assert rows(artefact.manifest(spark, path), "period", "version", "rows") == [(199806, 1, 2), (199806, 2, 3), (199807, 1, 1)]
    assert artefact.clean_report(spark, path, keep=2) == 0
    assert artefact.clean_report(spark, path) == 1
    assert read(spark, path, 199806) == [(2, 199806), (5, 199806), (7, 199806)]


def test_a_run_that_fails_half_way_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    artefact.commit_report(month_rows(spark, 199806, 1, 2), path, 199806)
    bad = F.when(F.col("outlet_id") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("outlet_id"))
    failing = month_rows(spark, 199806, 8, 9).repartition(2, "outlet_id").withColumn("outlet_id", bad.cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        artefact.commit_report(failing, path, 199806)
    with pytest.raises(ValueError, match="not of 199806"):
        artefact.commit_report(month_rows(spark, 199805, 4), path, 199806)
    assert read(spark, path) == [(1, 199806), (2, 199806)]
    assert len(list(Path(path, "runs").iterdir())) == 3
    assert artefact.clean_report(spark, path) == 2
    assert read(spark, path) == [(1, 199806), (2, 199806)]


def test_a_report_without_rows_is_a_report(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(ValueError, match="no report"):
        artefact.read_report(spark, path)
    assert artefact.clean_report(spark, path) == 0
    artefact.commit_report(month_rows(spark, 199806, 1), path, 199806)
    artefact.commit_report(month_rows(spark, 199806), path, 199806)
    assert read(spark, path, 199806) == []


def test_lost_rows_are_noticed(spark, tmp_path):
    path = str(tmp_path)
    run = artefact.commit_report(month_rows(spark, 199806, 1, 2).repartition(2, "outlet_id"), path, 199806)
    month_rows(spark, 199806, 1).write.mode("overwrite").parquet(f"{path}/runs/{run}")
    with pytest.raises(ValueError, match="1 rows of 199806 instead of the 2 committed"):
        artefact.read_report(spark, path)
