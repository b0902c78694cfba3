"""Sales lost to competitors (switches) and to originator products, per outlet."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletscope.constants import TYPE_GENERIC, TYPE_ORIGINATOR
from outletscope.functions.numbers import from_cents, sum_or_zero, to_cents
from outletscope.functions.text import presentation_label
from outletscope.operators.joins import in_period, sell, top_per_outlet
from outletscope.sources.domain import Domain


def excluded_articles(domain: Domain) -> DataFrame:
    return domain.ean.join(domain.excluded_ean, "ean", "left_semi").select("article_id")


def focus_offers(domain: Domain, focus_lab: str, as_of: date) -> DataFrame:
    """Running offers of the focus lab for articles that are not excluded.

    Exclusion keys are never NULL (checked at load), so the anti join equals NOT IN.
    """
    running = domain.offer.filter((F.col("lab") == focus_lab) & (F.col("valid_until") > F.lit(as_of)))
    return running.join(excluded_articles(domain), "article_id", "left_anti")


def focus_links(domain: Domain, focus_lab: str, as_of: date) -> DataFrame:
    """Links the focus lab has a running offer on, with its best rebate."""
    return focus_offers(domain, focus_lab, as_of).groupBy("link_id").agg(F.max("rebate").alias("best_rebate"))


def on_focus_links(offers: DataFrame, domain: Domain, focus_lab: str, as_of: date) -> DataFrame:
    """Offers on focus links. Many offers share a link, so links are made distinct before they are shuffled."""
    links = focus_offers(domain, focus_lab, as_of).select("link_id").distinct()
    return offers.join(links, "link_id", "left_semi")


def active_generic_groups(domain: Domain) -> DataFrame:
    """Groups that hold a generic article which is still sold."""
    active = domain.article.filter((F.col("type") == TYPE_GENERIC) & F.col("stopped_on").isNull())
    return domain.article_group.join(active, "article_id", "left_semi").select("group_id").distinct()


def labelled_groups(domain: Domain) -> DataFrame:
    parts = [F.col(c) for c in ("short_label", "pack", "volume", "unit")]
    return domain.link_group.select(
        "link_id", "group_id", "group_price", presentation_label(*parts).alias("label")
    )


def switch_items(domain: Domain, focus_lab: str, as_of: date) -> DataFrame:
    """Catalogue of switches: competitor offers, running or not, on focus links. Each offer counts."""
    competitor = domain.offer.filter(F.col("lab") != focus_lab)
    return (
        on_focus_links(competitor, domain, focus_lab, as_of)
        .join(labelled_groups(domain), "link_id")
        .join(active_generic_groups(domain), "group_id", "left_semi")
        .join(domain.lab, "lab", "left")
        .select("article_id", "link_id", "label", "lab_name", "rebate", to_cents(F.col("price")).alias("cents"))
    )


def originator_items(domain: Domain, focus_lab: str, as_of: date) -> DataFrame:
    """Catalogue of originators: offers of that type on focus links, under the maker of the article."""
    originator = domain.offer.filter(F.col("type") == TYPE_ORIGINATOR)
    makers = domain.article.join(domain.lab, F.col("maker_lab") == F.col("lab"))
    return (
        on_focus_links(originator.select("article_id", "link_id"), domain, focus_lab, as_of)
        .join(labelled_groups(domain), "link_id")
        .join(makers.select("article_id", "lab_name"), "article_id")
        .select("article_id", "link_id", "label", "lab_name", to_cents(F.col("group_price")).alias("cents"))
    )


def sold_by(sales: DataFrame, items: DataFrame, *keys: str, hot: DataFrame | None = None) -> DataFrame:
    """Quantity and value per outlet and catalogue key."""
    return (
        sell(sales, items, hot=hot)
        .groupBy("outlet_id", *keys)
        .agg(
            F.sum("qty").alias("qty"),
            from_cents(F.sum(F.col("qty") * F.col("cents"))).alias("value"),
        )
    )


def top_switch(
    domain: Domain,
    focus_lab: str,
    as_of: date,
    start: int,
    end: int | None = None,
    k: int = 10,
    items: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` largest switches of each outlet by value. ``items``: their catalogue, if already at hand; ``hot``: articles
    sold so often that their sums are dealt over many tasks."""
    items = switch_items(domain, focus_lab, as_of) if items is None else items
    keys = ("link_id", "label", "lab_name", "rebate")
    sold = sold_by(in_period(domain.sales, start, end), items, *keys, hot=hot)
    ties = [F.col(c).asc_nulls_last() for c in ("label", "lab_name", "rebate", "link_id")]
    return top_per_outlet(sold, k, F.col("value").desc_nulls_last(), *ties)


def top_originator(
    domain: Domain,
    focus_lab: str,
    as_of: date,
    start: int,
    end: int | None = None,
    k: int = 5,
    items: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` largest originator sales of each outlet by value."""
    items = originator_items(domain, focus_lab, as_of) if items is None else items
    keys = ("link_id", "label", "lab_name")
    sold = sold_by(in_period(domain.sales, start, end), items, *keys, hot=hot)
    ties = [F.col(c).asc_nulls_last() for c in ("label", "lab_name", "link_id")]
    return top_per_outlet(sold, k, F.col("value").desc_nulls_last(), *ties)


def per_outlet_or_zero(domain: Domain, totals: DataFrame, *names: str) -> DataFrame:
    filled = domain.outlet.select("outlet_id").join(totals, "outlet_id", "left")
    return filled.select("outlet_id", *[F.coalesce(c, F.lit(0)).cast("decimal(20,2)").alias(c) for c in names])


def item_total(domain: Domain, items: DataFrame, start: int, end: int | None, hot: DataFrame | None = None) -> DataFrame:
    sold = sell(in_period(domain.sales, start, end), items.select("article_id", "cents"), hot=hot)
    totals = sold.groupBy("outlet_id").agg(from_cents(F.sum(F.col("qty") * F.col("cents"))).alias("value"))
    return per_outlet_or_zero(domain, totals, "value")


def switch_total(
    domain: Domain, focus_lab: str, as_of: date, start: int, end: int | None = None, hot: DataFrame | None = None
) -> DataFrame:
    """Value of all switches of each outlet, 0 without any."""
    return item_total(domain, switch_items(domain, focus_lab, as_of), start, end, hot)


def originator_total(
    domain: Domain, focus_lab: str, as_of: date, start: int, end: int | None = None, hot: DataFrame | None = None
) -> DataFrame:
    """Value of all originator sales of each outlet, 0 without any."""
    return item_total(domain, originator_items(domain, focus_lab, as_of), start, end, hot)


def margin_total(
    domain: Domain,
    focus_lab: str,
    as_of: date,
    start: int,
    end: int | None = None,
    switch: DataFrame | None = None,
    originator: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Both totals and their sum, from one pass over the sales."""

    def side(items: DataFrame, name: str) -> DataFrame:
        return items.select("article_id", F.col("cents").alias(name))

    switch = switch_items(domain, focus_lab, as_of) if switch is None else switch
    originator = originator_items(domain, focus_lab, as_of) if originator is None else originator
    sides = side(switch, "switch_cents"), side(originator, "originator_cents")
    items = sides[0].unionByName(sides[1], allowMissingColumns=True)
    totals = (
        sell(in_period(domain.sales, start, end), items, hot=hot)
        .groupBy("outlet_id")
        .agg(
            sum_or_zero(F.col("qty") * F.col("switch_cents")).alias("switch_cents"),
            sum_or_zero(F.col("qty") * F.col("originator_cents")).alias("originator_cents"),
        )
        .select(
            "outlet_id",
            from_cents(F.col("switch_cents")).alias("switch_total"),
            from_cents(F.col("originator_cents")).alias("originator_total"),
            from_cents(F.col("switch_cents") + F.col("originator_cents")).alias("margin"),
        )
    )
    return per_outlet_or_zero(domain, totals, "switch_total", "originator_total", "margin")
