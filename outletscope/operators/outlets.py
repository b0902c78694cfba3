"""Outlet labels, contacts and the outlets that qualify for a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletscope.constants import MIN_OUTLET_ID, MIN_SHARE, OUTLET_WORD
from outletscope.functions.numbers import from_cents, money_ratio, to_cents
from outletscope.functions.text import outlet_label
from outletscope.operators.joins import in_period, sell
from outletscope.sources.domain import Domain


def outlet_labels(domain: Domain, wanted: DataFrame | None = None, word: str = OUTLET_WORD) -> DataFrame:
    """Display name of each outlet; an outlet asked for that is not known keeps a NULL label."""
    label = outlet_label(F.col("name"), F.col("postcode"), F.col("town"), word)
    labels = domain.outlet.select("outlet_id", label.alias("label"))
    return labels if wanted is None else wanted.select("outlet_id").join(labels, "outlet_id", "left")


def contacts(domain: Domain) -> DataFrame:
    """Code and mail per outlet; an outlet with several entries has as many rows."""
    return (
        domain.crm.join(domain.outlet_master, "outlet_id", "left")
        .join(domain.member, "finess", "left")
        .select("outlet_id", "code", "mail")
    )


def complete_outlets(domain: Domain, period: int) -> DataFrame:
    """Outlets with exactly one complete row in the month; a duplicate disqualifies."""
    month = domain.completeness.filter((F.col("period") == period) & (F.col("ok") == 1))
    return month.groupBy("outlet_id").agg(F.sum("ok").alias("n")).filter("n = 1").select("outlet_id")


def offer_items(domain: Domain, focus_lab: str) -> DataFrame:
    """Per article, the offer prices one sold unit counts with: all labs, and the focus lab alone."""
    is_focus = F.col("lab") == focus_lab
    cents = to_cents(F.col("price"))
    return domain.offer.groupBy("article_id").agg(
        F.sum(cents).alias("cents"),
        F.sum(F.when(is_focus, cents)).alias("focus_cents"),
        F.max(is_focus).alias("has_focus"),
    )


def focus_potential(domain: Domain, focus_lab: str, period: int) -> DataFrame:
    """Focus value and potential of each outlet in the month, from one pass over its sales.

    Either is NULL where no priced offer was sold; ``sold_focus`` tells whether any focus offer was.
    """
    return (
        sell(in_period(domain.sales, period), offer_items(domain, focus_lab))
        .groupBy("outlet_id")
        .agg(
            F.sum(F.col("qty") * F.col("focus_cents")).alias("focus_cents"),
            F.sum(F.col("qty") * F.col("cents")).alias("cents"),
            F.max("has_focus").alias("sold_focus"),
        )
    )


def eligible_outlets(
    domain: Domain,
    focus_lab: str,
    period: int,
    group_no: int,
    min_share: float = MIN_SHARE,
    min_outlet_id: int = MIN_OUTLET_ID,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Complete outlets of the group whose focus share of the potential reaches ``min_share``."""
    members = domain.outlet_group.filter(F.col("group_no") == group_no).select("outlet_id")
    share = money_ratio(F.col("focus_cents"), F.col("cents"))
    kept = (
        focus_potential(domain, focus_lab, period)
        .filter((F.col("outlet_id") > min_outlet_id) & F.col("sold_focus") & (share >= min_share))
        .join(complete_outlets(domain, period), "outlet_id", "left_semi")
        .join(members, "outlet_id", "left_semi")
    )
    if wanted is not None:
        kept = kept.join(wanted, "outlet_id", "left_semi")
    return kept.join(contacts(domain), "outlet_id", "left").select(
        "outlet_id",
        "code",
        "mail",
        from_cents(F.col("focus_cents")).alias("focus_value"),
        from_cents(F.col("cents")).alias("potential"),
        share.alias("share"),
    )
