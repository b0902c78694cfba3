from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from outletscope.constants import HOLIDAYS_2025, MOLECULE_RULES
from outletscope.functions import numbers, periods, text


def values(spark, rows, kind, expression):
    """The expression over a column ``x`` of the given rows, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i INT, x {kind}")
    return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


# --- periods


def test_previous_month_clamps_or_overflows(spark):
    days = [date(2025, 3, 31), date(2025, 1, 31), date(2025, 1, 1), date(2024, 3, 30), date(2025, 7, 17)]
    assert values(spark, days, "DATE", periods.previous_month) == [202502, 202412, 202412, 202402, 202506]
    overflow = values(spark, days, "DATE", lambda d: periods.previous_month(d, overflow=True))
    assert overflow == [202503, 202412, 202412, 202403, 202506]
    assert [periods.previous_month_of(d) for d in days] == [202502, 202412, 202412, 202402, 202506]
    assert [periods.previous_month_of(d, overflow=True) for d in days] == overflow


def test_month_label(spark):
    assert values(spark, [202501, 202508, 202512], "INT", periods.month_label) == [
        "Janvier 2025",
        "Août 2025",
        "Décembre 2025",
    ]


def test_windows(spark):
    assert periods.trailing_months(202507) == (202502, 202507)
    assert periods.trailing_months(202503) == (202410, 202503)
    assert periods.trailing_months(202505, 6) == (202412, 202505)
    assert periods.since(202503, 202503) == (202503, 202503)
    with pytest.raises(ValueError):
        periods.since(202503, 202502)
    shifted = values(spark, [202507, 202503, 202505], "INT", lambda k: periods.shift_month(k, -5))
    assert shifted == [202502, 202410, 202412]
    assert periods.month_start(202512) == date(2025, 12, 1)
    assert periods.month_after(202512) == date(2026, 1, 1)
    assert periods.month_after(202511) == date(2025, 12, 1)


def test_send_dates(spark):
    months = [202505, 202508, 202506, 202507]
    got = values(spark, months, "INT", lambda k: periods.send_date(k, holidays=HOLIDAYS_2025))
    assert got == [date(2025, 5, 19), date(2025, 8, 18), date(2025, 6, 17), date(2025, 7, 17)]


def test_roll_forward_over_holidays_and_month_end(spark):
    closed = [date(2025, 5, 30), date(2025, 6, 2), date(2025, 6, 3)]
    days = [date(2025, 5, 30), date(2025, 5, 31), date(2025, 6, 3), date(2025, 5, 29)]
    got = values(spark, days, "DATE", lambda d: periods.next_business_day(d, closed))
    assert got == [date(2025, 6, 4), date(2025, 6, 4), date(2025, 6, 4), date(2025, 5, 29)]
    assert periods.longest_closed_run(closed) == 5
    assert periods.longest_closed_run([]) == 2


# --- numbers


def test_share_percent(spark):
    df = spark.createDataFrame(
        [(Decimal("1.00"), Decimal("3.00")), (Decimal("2.00"), Decimal("3.00")), (Decimal("0.00"), Decimal("0.00")),
         (Decimal("1.00"), Decimal("8.00")), (Decimal("-1.00"), Decimal("8.00"))],
        "a DECIMAL(20,2), b DECIMAL(20,2)",
    )
    got = [r[0] for r in df.select(numbers.share_percent(F.col("a"), F.col("b"))).collect()]
    assert got == [Decimal(x) for x in ("33.33", "66.67", "0.00", "12.50", "-12.50")]


def test_truncated_share(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (0, 0), (5, 0), (25, 10)], "a BIGINT, b BIGINT")
    got = [r[0] for r in df.select(numbers.truncated_share(F.col("a"), F.col("b"))).collect()]
    assert got == [Decimal(x) for x in ("33.33", "66.66", "0.00", "0.00", "250.00")]


def test_bands(spark):
    assert values(spark, [49.99, 50.0, 80.0, 80.01], "DOUBLE", numbers.share_band) == ["pdm-low", "", "", "pdm-high"]


@pytest.mark.parametrize("share, gaps", [("29.99", (True, True)), ("30", (False, True)), ("49.99", (False, True)), ("50", (False, False))])
def test_gap_ends_at_the_target(spark, share, gaps):
    share = Decimal(share)
    df = spark.createDataFrame([(share, share, Decimal(100))], "s DECIMAL(10,2), part DECIMAL(20,2), whole DECIMAL(20,2)")
    for target, open_gap in zip((30, 50), gaps):
        gap = df.select(numbers.gap_to_target(F.col("s"), F.col("part"), F.col("whole"), target)).first()[0]
        assert gap == (target - share if open_gap else 0)


def test_allowed_outlets(spark):
    people = [0, 2499, 2500, 6999, 7000, 11500]
    assert values(spark, people, "BIGINT", numbers.allowed_outlets) == [0, 0, 1, 1, 2, 3]


def test_money_is_exact(spark):
    amounts = [Decimal("0.01"), Decimal("19.99"), Decimal("9999999999.99")]
    assert values(spark, amounts, "DECIMAL(12,2)", lambda x: numbers.from_cents(numbers.to_cents(x))) == amounts


# --- text


def test_presentation_label_keeps_inner_spaces_of_missing_parts(spark):
    df = spark.createDataFrame(
        [("AMOX  ", "BT 12 ", "500", "MG "), ("AMOX", None, None, "MG"), ("AMOX", "3", "", None), (None, None, None, None)],
        "a STRING, b STRING, c STRING, d STRING",
    )
    label = text.presentation_label(*[F.col(c) for c in "abcd"])
    assert [r[0] for r in df.select(label).collect()] == ["AMOX BT 12 500 MG", "AMOX   MG", "AMOX 3", ""]


def test_outlet_label(spark):
    df = spark.createDataFrame(
        [(" Grande PHARMACIE ", "44380", "Pornic "), ("Dupont", "01000", None), (None, None, None), ("Pharmacies Unies", "1", "x"),
         ("\tLa pharmacie du Port\r\n", " 2", "y")],
        "n STRING, p STRING, t STRING",
    )
    label = text.outlet_label(F.col("n"), F.col("p"), F.col("t"))
    assert [r[0] for r in df.select(label).collect()] == [
        "Grande PHARMACIE - 44380  Pornic",
        "Pharmacie Dupont - 01000  ",
        "Pharmacie  -   ",
        "Pharmacie Pharmacies Unies - 1  x",
        "La pharmacie du Port - 2  y",
    ]


def test_cut_and_capitalise(spark):
    texts = ["x" * 80, "x" * 81, "", "ÉTÉ À LA MER", None]
    assert values(spark, texts, "STRING", lambda t: text.cut_text(t, 80)) == ["x" * 80, "x" * 80 + " ", "", "ÉTÉ À LA MER", None]
    assert values(spark, texts, "STRING", text.capitalise) == ["X" + "x" * 79, "X" + "x" * 80, "", "Été à la mer", None]


def test_money_and_percent_text(spark):
    amounts = [Decimal("1234567.50"), Decimal("0"), Decimal("-3.1"), Decimal("2.675")]
    assert values(spark, amounts, "DECIMAL(20,4)", text.money_text) == ["1234567.50€", "0.00€", "-3.10€", "2.68€"]
    shares = [Decimal("33.30"), Decimal("0"), Decimal("100"), Decimal("50.05")]
    assert values(spark, shares, "DECIMAL(10,2)", text.percent_text) == ["33.3 %", "0 %", "100 %", "50.05 %"]


def test_classify_molecule(spark):
    names = ["FILGRASTIM  30 MU", "PEGFILGRASTIM 6 MG", "filgrastim peg", "Epoetine alfa", "OTHER", "ENOXAPARINE sodique"]
    assert values(spark, names, "STRING", lambda n: text.classify_molecule(n, MOLECULE_RULES)) == [1, 2, None, 3, None, 6]
    reversed_rules = tuple(reversed(MOLECULE_RULES))
    assert values(spark, names, "STRING", lambda n: text.classify_molecule(n, reversed_rules)) == [1, 2, None, 3, None, 6]


def test_starts_with_any(spark):
    texts = ["Filgrastim 30", "PEGFILGRASTIM", "xfilgrastim", "Été 2 MG", "a+b c", "line\nfilgrastim", "", None]
    found = values(spark, texts, "STRING", lambda t: text.starts_with_any(t, ("filgrastim", "pegfil", "ÉTÉ 2", "A+B")))
    assert found == [True, True, False, True, True, False, False, None]
