"""Result tables as display text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletscope.constants import LAB_WIDTH, LABEL_WIDTH, NO_DATA_TEXT
from outletscope.functions.numbers import share_band
from outletscope.functions.text import capitalise, cut_text, money_text, percent_text


def name_text(c: Column, width: int) -> Column:
    return capitalise(cut_text(c, width))


def with_placeholder(outlets: DataFrame, table: DataFrame, message: str = NO_DATA_TEXT) -> DataFrame:
    """Every outlet appears: one without rows gets one that carries the message."""
    marked = table.withColumn("has_data", F.lit(True))
    shown = outlets.select("outlet_id").join(marked, "outlet_id", "left")
    has_data = F.coalesce("has_data", F.lit(False))
    return shown.withColumn("has_data", has_data).withColumn("message", F.when(~has_data, message))


def display_switch(outlets: DataFrame, top: DataFrame) -> DataFrame:
    shown = top.select(
        "outlet_id",
        "rank",
        name_text(F.col("label"), LABEL_WIDTH).alias("label_text"),
        F.col("qty").cast("string").alias("qty_text"),
        money_text(F.col("value")).alias("value_text"),
    )
    return with_placeholder(outlets, shown)


def display_originator(outlets: DataFrame, top: DataFrame) -> DataFrame:
    shown = top.select(
        "outlet_id",
        "rank",
        name_text(F.col("label"), LABEL_WIDTH).alias("label_text"),
        name_text(F.col("lab_name"), LAB_WIDTH).alias("lab_text"),
        F.col("qty").cast("string").alias("qty_text"),
        money_text(F.col("value")).alias("value_text"),
    )
    return with_placeholder(outlets, shown)


def display_launch(outlets: DataFrame, scorecard: DataFrame) -> DataFrame:
    counts = ("focus_qty", "competitor_qty", "originator_qty")
    shown = scorecard.select(
        "outlet_id",
        "rank",
        "dci",
        percent_text(F.col("share")).alias("share_text"),
        share_band(F.col("share")).alias("band"),
        *[F.col(c).cast("string").alias(c.replace("_qty", "_text")) for c in counts],
    )
    return with_placeholder(outlets, shown)


def display_molecules(outlets: DataFrame, scorecard: DataFrame) -> DataFrame:
    shown = scorecard.select(
        "outlet_id",
        "sort_order",
        "is_total",
        "molecule",
        F.col("focus_qty").cast("string").alias("focus_qty_text"),
        F.col("other_qty").cast("string").alias("other_qty_text"),
        money_text(F.col("focus_value")).alias("focus_value_text"),
        money_text(F.col("other_value")).alias("other_value_text"),
        percent_text(F.col("share")).alias("share_text"),
        share_band(F.col("share")).alias("band"),
    )
    return with_placeholder(outlets, shown)


def display_gaps(gaps: DataFrame) -> DataFrame:
    """Money text of every gap; a target already met reads 0.00€."""
    texts = [money_text(F.col(c)).alias(f"{c}_text") for c in gaps.columns if c.startswith("gap_")]
    return gaps.select("outlet_id", *texts)


def display_totals(totals: DataFrame) -> DataFrame:
    """Money text of the leakage totals."""
    names = ("switch_total", "originator_total", "margin")
    return totals.select("outlet_id", *[money_text(F.col(c)).alias(f"{c}_text") for c in names])
