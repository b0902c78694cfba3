"""Market share of launched substances, per outlet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outletscope.constants import TYPE_ORIGINATOR, TYPES_GENERIC_TOTAL
from outletscope.functions.numbers import sum_or_zero, truncated_share
from outletscope.operators.joins import global_rank, in_period, sell, top_per_outlet
from outletscope.sources.domain import Domain

MEASURES = ("focus_qty", "competitor_qty", "originator_qty")


def launch_articles(domain: Domain) -> DataFrame:
    return domain.ean.join(domain.launch_ean, "ean", "left_semi").select("article_id")


def launched_substances(domain: Domain) -> DataFrame:
    """Names of the substances any launched article belongs to: the spine of the scorecard."""
    launched = domain.article_group.join(launch_articles(domain), "article_id", "left_semi")
    groups = launched.select("group_id").distinct()
    return domain.dci.join(groups, "group_id", "left_semi").select("dci").distinct()


def launch_items(domain: Domain, focus_lab: str) -> DataFrame:
    """Catalogue of launched articles: substance, and which measures a sold unit counts in.

    The focus count takes every type the lab makes while the total takes generics only, so a share may
    exceed 100. An article of unknown maker counts in the total but for no one.
    """
    generic = F.col("type").isin(*TYPES_GENERIC_TOTAL)
    return (
        domain.article.join(launch_articles(domain), "article_id", "left_semi")
        .join(domain.article_group, "article_id")
        .join(domain.dci.select("group_id", "dci"), "group_id")
        .select(
            "article_id",
            "dci",
            (F.col("maker_lab") == focus_lab).alias("is_focus"),
            ((F.col("maker_lab") != focus_lab) & generic).alias("is_competitor"),
            (F.col("type") == TYPE_ORIGINATOR).alias("is_originator"),
            generic.alias("is_generic"),
        )
    )


def launch_sales(domain: Domain, focus_lab: str, start: int, end: int) -> DataFrame:
    """Quantities and share per outlet and substance, for the pairs that have sales."""

    def sold(flag: str) -> Column:
        return sum_or_zero(F.when(F.col(flag), F.col("qty")))

    return (
        sell(in_period(domain.sales, start, end), launch_items(domain, focus_lab))
        .groupBy("outlet_id", "dci")
        .agg(
            truncated_share(sold("is_focus"), sold("is_generic")).alias("share"),
            sold("is_focus").alias("focus_qty"),
            sold("is_competitor").alias("competitor_qty"),
            sold("is_originator").alias("originator_qty"),
        )
    )


def ranked_substances(domain: Domain) -> DataFrame:
    """The spine with each name's place in name order; names are dealt out by their first letters."""
    return global_rank(launched_substances(domain), F.substring("dci", 1, 2), "dci")


def unsold_substances(domain: Domain, sold: DataFrame, k: int) -> DataFrame:
    """outlet_id and name of the first ``k`` substances, in name order, that an outlet did not sell.

    Of an outlet's sold names, the j-th stands at place r of the spine, with r - j unsold names before it. So the m-th
    unsold name stands at place m plus the number of sold names with r - j < m: ``k`` counts per outlet.
    """
    spine = ranked_substances(domain)
    order = W.partitionBy("outlet_id").orderBy("rank")
    places = sold.select("outlet_id", "dci").join(spine, "dci")
    gaps = places.select("outlet_id", (F.col("rank") - F.row_number().over(order)).alias("unsold_before"))
    counts = [F.count_if(F.col("unsold_before") < m).alias(f"m{m}") for m in range(1, k + 1)]
    shifts = domain.outlet.select("outlet_id").join(gaps.groupBy("outlet_id").agg(*counts), "outlet_id", "left")
    wanted = F.array(*[F.coalesce(f"m{m}", F.lit(0)) + m for m in range(1, k + 1)])
    return shifts.select("outlet_id", F.explode(wanted).alias("rank")).join(spine, "rank").select("outlet_id", "dci")


def launch_scorecard(domain: Domain, focus_lab: str, start: int, end: int, k: int = 10) -> DataFrame:
    """The ``k`` launched substances with the highest share in each outlet, unsold ones at 0.

    An outlet needs no more than ``k`` of the substances it did not sell, the first in name order, since all of them
    tie at 0.
    """
    sold = launch_sales(domain, focus_lab, start, end)
    known = sold.join(domain.outlet.select("outlet_id"), "outlet_id", "left_semi")
    unsold = unsold_substances(domain, sold, k).select(
        "outlet_id", "dci", F.lit(0).cast("decimal(20,2)").alias("share"), *[F.lit(0).cast("bigint").alias(m) for m in MEASURES]
    )
    ranked = top_per_outlet(known.unionByName(unsold), k, F.desc("share"), F.asc("dci"))
    return ranked.select("outlet_id", "rank", "dci", "share", *MEASURES)
