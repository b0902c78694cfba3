"""Outlets against population, per area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outletscope.functions.numbers import allowed_outlets

#: Ranges that values are dealt into for counting.
RANGES = 256


def outlet_quota(areas: DataFrame) -> DataFrame:
    return areas.withColumn("allowed", allowed_outlets(F.col("population")))


def quota_gap(areas: DataFrame) -> DataFrame:
    """Allowed and actual outlets, the surplus of the actual ones, and inhabitants per outlet."""
    per_outlet = F.try_divide(F.col("population").cast("double"), F.col("outlets").cast("double"))
    return (
        outlet_quota(areas)
        .withColumn("surplus", F.col("outlets") - F.col("allowed"))
        .withColumn("inhabitants_per_outlet", per_outlet)
    )


def population_correlation(areas: DataFrame) -> DataFrame:
    """How the number of outlets follows population: correlation and regression line."""
    population, outlets = F.col("population").cast("double"), F.col("outlets").cast("double")
    return areas.agg(
        F.count("*").alias("areas"),
        F.corr(population, outlets).alias("correlation"),
        F.regr_slope(outlets, population).alias("slope"),
        F.regr_intercept(outlets, population).alias("intercept"),
    )


def density_bands(areas: DataFrame, n: int = 5) -> DataFrame:
    """Colour band 1..n of each area by inhabitants per outlet; areas without outlets have none.

    The edges are exact quantiles: the least values with i / n of the areas at or below them. Values are dealt into
    ranges, by rough quantiles, that only decide which task counts which values; running counts inside a range and the
    totals of the ranges before it give every value's exact place. An area on an edge belongs to the lower band.
    """
    gap = quota_gap(areas)
    value = F.col("inhabitants_per_outlet")
    counted = gap.filter(value.isNotNull()).groupBy("inhabitants_per_outlet").agg(F.count("*").alias("areas"))
    cuts = counted.agg(F.percentile_approx("inhabitants_per_outlet", [i / RANGES for i in range(1, RANGES)])).scalar()
    dealt = counted.withColumn("cuts", cuts).select(
        "inhabitants_per_outlet", "areas", F.size(F.filter("cuts", lambda cut: cut < value)).alias("range")
    )
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy("range").agg(F.sum("areas").alias("of_range"))
    before = totals.select("range", F.coalesce(F.sum("of_range").over(earlier), F.lit(0)).alias("before"))
    inside = F.sum("areas").over(W.partitionBy("range").orderBy("inhabitants_per_outlet"))
    placed = dealt.withColumn("inside", inside).join(before, "range")
    at_or_below, everything = F.col("before") + F.col("inside"), counted.agg(F.sum("areas")).scalar()
    reached = [F.min(F.when(F.col("reached") * n >= F.col("everything") * i, value)) for i in range(1, n)]
    edges = placed.withColumn("reached", at_or_below).withColumn("everything", everything).agg(F.array(*reached)).scalar()
    above = F.filter("edges", lambda edge: edge < value)
    band = F.when(value.isNotNull(), F.size(above) + 1)
    return gap.withColumn("edges", edges).withColumn("band", band).drop("edges")
