"""Market share by molecule with zero-filled rows and a total, and what is missing to share targets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletscope.constants import (
    GAP_TARGETS,
    GROUP_PREFIXES,
    MOLECULE_RULES,
    TOTAL_NAME,
    TOTAL_SORT,
    TYPES_BIOSIMILAR,
    MoleculeRule,
)
from outletscope.functions.numbers import from_cents, gap_to_target, share_percent, to_cents
from outletscope.functions.text import classify_molecule, starts_with_any, substance_name
from outletscope.operators.joins import in_period, sell
from outletscope.sources.domain import Domain

Rules = Sequence[MoleculeRule]


def classified_substances(domain: Domain, rules: Rules = MOLECULE_RULES) -> DataFrame:
    """Every substance row with its full name and the sort order of its molecule, NULL for none."""
    name = substance_name(F.col("dci"), F.col("dose"), F.col("form"))
    return domain.dci.select("group_id", name.alias("name")).withColumn(
        "sort_order", classify_molecule(F.col("name"), rules)
    )


def prefixed_groups(domain: Domain, prefixes: Sequence[str] = GROUP_PREFIXES) -> DataFrame:
    matching = domain.link_group.filter(starts_with_any(F.col("short_label"), prefixes))
    return matching.select("group_id").distinct()


def with_active_price(articles: DataFrame, domain: Domain) -> DataFrame:
    """Articles with the active regulated price. The flag belongs to the join: no price, no loss of the row."""
    active = domain.regulated_price.filter(F.col("active") == 1)
    cents = to_cents(F.col("price")).alias("price_cents")
    return articles.join(active.select("article_id", cents), "article_id", "left")


def molecule_items(
    domain: Domain, focus_lab: str, rules: Rules = MOLECULE_RULES, prefixes: Sequence[str] = GROUP_PREFIXES
) -> DataFrame:
    """Catalogue of scored articles: molecule, side and price. Each joined row counts, priced or not."""
    substances = classified_substances(domain, rules).filter(F.col("sort_order").isNotNull())
    makers = domain.lab.select(F.col("lab").alias("maker_lab"))
    made = domain.article.filter(F.col("type").isin(*TYPES_BIOSIMILAR)).join(makers, "maker_lab")
    return (
        with_active_price(made, domain)
        .join(domain.article_group, "article_id")
        .join(prefixed_groups(domain, prefixes), "group_id", "left_semi")
        .join(substances, "group_id")
        .select("article_id", "sort_order", (F.col("maker_lab") == focus_lab).alias("is_focus"), "price_cents")
    )


def card_sums(
    rules: Rules, is_focus: Column, qty: Column, cents: Column, suffix: str = "", summed: Callable[[Column], Column] = F.sum
) -> list[Column]:
    """A sum for each rule, side and measure, by column sort_order."""
    sides = {"focus": is_focus, "other": ~is_focus}
    measures = {"qty": qty, "cents": cents}
    return [
        summed(F.when((F.col("sort_order") == rule.sort_order) & on_side, amount)).alias(f"{side}_{measure}_{rule.sort_order}{suffix}")
        for rule in rules
        for side, on_side in sides.items()
        for measure, amount in measures.items()
    ]


def card_rows(rules: Rules, suffix: str = "") -> Column:
    """The rows of an outlet as an array, from the sums of `card_sums`: one per rule, sold or not, and the total."""
    if len({rule.sort_order for rule in rules}) < len(rules):
        raise ValueError("two rules with the same sort order")

    def amount(name: str, orders: Sequence[int]) -> Column:
        return reduce(add, [F.coalesce(f"{name}_{order}{suffix}", F.lit(0).cast("bigint")) for order in orders])

    def row(display: str, orders: Sequence[int], sort_order: int, is_total: bool) -> Column:
        focus, other = from_cents(amount("focus_cents", orders)), from_cents(amount("other_cents", orders))
        return F.struct(
            F.lit(sort_order).alias("sort_order"),
            F.lit(display).alias("molecule"),
            amount("focus_qty", orders).alias("focus_qty"),
            amount("other_qty", orders).alias("other_qty"),
            focus.alias("focus_value"),
            other.alias("other_value"),
            share_percent(focus, focus + other).alias("share"),
            F.lit(is_total).alias("is_total"),
        )

    rows = [row(rule.display, [rule.sort_order], rule.sort_order, False) for rule in rules]
    return F.array(*rows, row(TOTAL_NAME, [rule.sort_order for rule in rules], TOTAL_SORT, True))


def molecule_scorecard(
    domain: Domain,
    focus_lab: str,
    start: int,
    end: int | None = None,
    rules: Rules = MOLECULE_RULES,
    prefixes: Sequence[str] = GROUP_PREFIXES,
    items: DataFrame | None = None,
) -> DataFrame:
    """One row per outlet and molecule, sold or not, and a total row per outlet.

    ``items`` is the catalogue of scored articles, if already at hand. One aggregation per outlet holds a sum for each
    rule and side, and rows are laid out from it: detail and total share the pass, and no spine is joined. The rules'
    sort orders must differ.
    """
    rules = sorted(rules)
    items = molecule_items(domain, focus_lab, rules, prefixes) if items is None else items
    sold = sell(in_period(domain.collection, start, end), items)
    sums = card_sums(rules, F.col("is_focus"), F.col("qty"), F.col("qty") * F.col("price_cents"))
    columns = ("molecule", "focus_qty", "other_qty", "focus_value", "other_value", "share", "is_total", "sort_order")
    return (
        domain.outlet.select("outlet_id")
        .join(sold.groupBy("outlet_id").agg(*sums), "outlet_id", "left")
        .select("outlet_id", F.inline(card_rows(rules)))
        .select("outlet_id", *columns)
    )


def gap_columns(share: Column, focus: Column, other: Column, targets: Sequence[float], suffix: str = "") -> list[Column]:
    """Total share, and the focus value missing to each target."""
    gaps = [gap_to_target(share, focus, focus + other, t).alias(f"gap_{t}{suffix}") for t in targets]
    return [share.alias(f"total_share{suffix}"), *gaps]


def share_gap(scorecard: DataFrame, targets: Sequence[float] = GAP_TARGETS) -> DataFrame:
    """The gaps of each outlet, from its total row."""
    columns = gap_columns(F.col("share"), F.col("focus_value"), F.col("other_value"), targets)
    return scorecard.filter("is_total").select("outlet_id", *columns)
