"""All that a report says of an outlet, from one pass over the sales.

The catalogues of all tables are laid one under the other, each row with the table it is for (its tag). The fact is read
once, cut to the articles any of them wants, and summed to outlet and article, with a quantity for each window of months.
These sums meet the tagged catalogue once and are grouped once by tag and key; ranks are given inside of outlet and tag;
one row per outlet gathers the short tables and totals.

An amount beyond a long is a fault of its outlet: its sum is NULL and `fault` says so, while the others' stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outletscope.constants import TYPES_BIOSIMILAR, MoleculeRule
from outletscope.functions.numbers import from_cents, truncated_share
from outletscope.operators.joins import of_wanted
from outletscope.operators.launches import launch_articles, launch_items, ranked_substances
from outletscope.operators.molecules import card_sums, molecule_items
from outletscope.operators.offers import originator_items, switch_items
from outletscope.operators.outlets import offer_items
from outletscope.sources.domain import Domain

TAGS = ("switch", "originator", "launch", "molecule", "offer")
SWITCH, ORIGINATOR, LAUNCH, MOLECULE, OFFER = TAGS
KEYS = ("link_id", "label", "lab_name", "rebate", "sort_order", "is_focus")
SIDES = ("focus", "competitor", "originator")

#: Rows of each top table.
TOP = {SWITCH: 10, ORIGINATOR: 5, LAUNCH: 10}


@dataclass(frozen=True)
class Months:
    """The month reported on, and the first months of the trailing window of sales and of the window of the collection."""

    period: int
    trailing_start: int
    since_start: int

    def windows(self, of_sales: Column, of_collection: Column) -> list[Column]:
        """Sales in the month, sales in the trailing months, collection in the month, collection since its start."""
        month = F.col("period") == self.period
        return [
            of_sales & month,
            of_sales & F.col("period").between(self.trailing_start, self.period),
            of_collection & month,
            of_collection & F.col("period").between(self.since_start, self.period),
        ]


def summed(amount: Column) -> Column:
    """A sum that is NULL, not an error, beyond a long."""
    return F.try_sum(amount)


def lost(amount: Column) -> Column:
    """Whether there was something to sum and its sum is beyond a long."""
    return (F.count(amount) > 0) & F.try_sum(amount).isNull()


def tagged_catalogue(domain: Domain, focus_lab: str, as_of: date, rules: Sequence[MoleculeRule], prefixes: Sequence[str]) -> DataFrame:
    """The catalogues of all tables: article_id, tag, and the columns of each."""
    launched = launch_items(domain, focus_lab).withColumnsRenamed(
        {"is_focus": "of_focus", "is_competitor": "of_competitor", "is_originator": "of_originator", "is_generic": "of_all"}
    )
    spine = ranked_substances(domain).select(F.col("dci"), F.col("rank").alias("spine"))
    tables = {
        SWITCH: switch_items(domain, focus_lab, as_of),
        ORIGINATOR: originator_items(domain, focus_lab, as_of),
        LAUNCH: launched.join(spine, "dci").withColumnRenamed("dci", "label"),
        MOLECULE: molecule_items(domain, focus_lab, rules, prefixes).withColumnRenamed("price_cents", "cents"),
        OFFER: offer_items(domain, focus_lab),
    }
    tagged = [items.withColumn("tag", F.lit(tag)) for tag, items in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def wanted_articles(domain: Domain) -> DataFrame:
    """The articles of the catalogues and few others, without the catalogues' joins: what the fact is cut to."""
    scored = domain.article.filter(F.col("type").isin(*TYPES_BIOSIMILAR))
    tables = (domain.offer, launch_articles(domain), scored)
    return reduce(DataFrame.unionByName, [t.select("article_id") for t in tables])


def window_cells(domain: Domain, months: Months) -> DataFrame:
    """outlet_id, article_id, and per window the quantity (`qty`) and whether there are sales (`sold`)."""
    columns = ("outlet_id", "article_id", "period", "qty")
    yes, no = F.lit(True), F.lit(False)
    if domain.collection.sameSemantics(domain.sales):
        facts = domain.sales.select(*columns)
        windows = months.windows(yes, yes)
    else:
        sides = [fact.select(*columns, mark.alias("is_sale")) for fact, mark in ((domain.sales, yes), (domain.collection, no))]
        facts = sides[0].unionByName(sides[1])
        windows = months.windows(F.col("is_sale"), ~F.col("is_sale"))
    first = min(months.period, months.trailing_start, months.since_start)
    kept = of_wanted(facts.filter(F.col("period").between(first, months.period)), wanted_articles(domain))
    quantities = [F.when(w, F.col("qty")) for w in windows]
    return kept.groupBy("outlet_id", "article_id").agg(
        F.array(*[summed(x) for x in quantities]).alias("qty"),
        F.array(*[F.count_if(w) > 0 for w in windows]).alias("sold"),
        reduce(Column.__or__, [lost(x) for x in quantities]).alias("fault"),
    )


def outlet_lines(cells: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row per outlet, tag and key, with its sums and its rank among those of the same outlet and tag."""
    qty, sold = F.col("qty"), F.col("sold")
    value = [F.try_multiply(qty[i], F.col("cents")) for i in range(4)]
    focus_value = F.try_multiply(qty[0], F.col("focus_cents"))
    trailing = {side: F.when(F.col(f"of_{side}"), qty[1]) for side in (*SIDES, "all")}
    beyond = [qty[i].isNotNull() & F.col("cents").isNotNull() & value[i].isNull() for i in range(4)]
    beyond.append(qty[0].isNotNull() & F.col("focus_cents").isNotNull() & focus_value.isNull())
    amounts = {
        "month_qty": qty[0],
        "month_cents": value[0],
        "focus_cents": focus_value,
        **{f"{side}_qty": amount for side, amount in trailing.items()},
        "card_qty": qty[2],
        "card_cents": value[2],
        "since_qty": qty[3],
        "since_cents": value[3],
    }
    faults = [F.bool_or("fault"), F.bool_or(reduce(Column.__or__, beyond)), *[lost(x) for x in amounts.values()]]
    lines = cells.join(catalogue, "article_id").groupBy("outlet_id", "tag", *KEYS).agg(
        *[summed(x).alias(name) for name, x in amounts.items()],
        F.bool_or(sold[0]).alias("in_month"),
        F.bool_or(sold[1]).alias("in_trailing"),
        F.max(F.when(sold[0], F.col("has_focus"))).alias("has_focus"),
        F.max("spine").alias("spine"),
        reduce(Column.__or__, [F.coalesce(f, F.lit(False)) for f in faults]).alias("fault"),
    )
    zero = F.lit(0).cast("bigint")
    lines = lines.withColumns({f"{side}_qty": F.coalesce(f"{side}_qty", zero) for side in (*SIDES, "all")})
    share = F.coalesce(truncated_share(F.col("focus_qty"), F.col("all_qty")), F.lit(0))
    shown = F.when(F.col("tag") == LAUNCH, F.col("in_trailing")).otherwise(F.col("in_month"))
    measure = F.when(F.col("tag") == LAUNCH, share).otherwise(from_cents(F.col("month_cents")))
    own = W.partitionBy("outlet_id", "tag", "shown")
    ties = [F.col(c).asc_nulls_last() for c in ("label", "lab_name", "rebate", "link_id")]
    return (
        lines.withColumns({"shown": shown, "measure": measure})
        .withColumn("rank", F.row_number().over(own.orderBy(F.col("measure").desc_nulls_last(), *ties)))
        .withColumn("unsold_before", F.col("spine") - F.row_number().over(own.orderBy("spine")))
    )


def outlet_figures(
    domain: Domain, months: Months, focus_lab: str, as_of: date, rules: Sequence[MoleculeRule], prefixes: Sequence[str]
) -> DataFrame:
    """One row per outlet with sales: its top tables as arrays, the sums of its totals, and what eligibility asks for.

    launches holds the substances sold, of the first places; unsold the places, in the list of names, of the first
    substances that were not sold (see `with_launches`).
    """
    rules = sorted(rules)
    catalogue = tagged_catalogue(domain, focus_lab, as_of, rules, prefixes)
    lines = outlet_lines(window_cells(domain, months), catalogue)

    def of(tag: str) -> Column:
        return F.col("tag") == tag

    def table(tag: str, *columns: str | Column) -> Column:
        row = F.when(of(tag) & F.col("shown") & (F.col("rank") <= TOP[tag]), F.struct(*columns))
        return F.sort_array(F.collect_list(row))

    def total(tag: str, name: str) -> Column:
        return summed(F.when(of(tag), F.col(name)))

    def no_total(tag: str, name: str) -> Column:
        return lost(F.when(of(tag), F.col(name)))

    k = TOP[LAUNCH]
    unsold = [F.count_if(of(LAUNCH) & F.col("shown") & (F.col("unsold_before") < m)) + m for m in range(1, k + 1)]
    amounts = ("rank", "link_id", "label", "lab_name"), (F.col("month_qty").alias("qty"), F.col("measure").alias("value"))
    sums = [(SWITCH, "month_cents"), (ORIGINATOR, "month_cents"), (OFFER, "month_cents"), (OFFER, "focus_cents")]
    cards = {"": ("card_qty", "card_cents"), "_since": ("since_qty", "since_cents")}
    return lines.groupBy("outlet_id").agg(
        table(SWITCH, *amounts[0], "rebate", *amounts[1]).alias("top_switch"),
        table(ORIGINATOR, *amounts[0], *amounts[1]).alias("top_originator"),
        table(LAUNCH, "rank", F.col("label").alias("dci"), F.col("measure").alias("share"), *[f"{s}_qty" for s in SIDES]).alias("sold"),
        F.array(*unsold).alias("unsold"),
        *[total(*s).alias(f"{s[0]}_{s[1]}") for s in sums],
        F.max(F.when(of(OFFER), F.col("has_focus"))).alias("sold_focus"),
        *[
            c
            for suffix, (qty, cents) in cards.items()
            for c in card_sums(rules, F.when(of(MOLECULE), F.col("is_focus")), F.col(qty), F.col(cents), suffix, summed)
        ],
        (F.bool_or("fault") | reduce(Column.__or__, [no_total(*s) for s in sums])).alias("fault"),
    )


def with_launches(figures: DataFrame, domain: Domain) -> DataFrame:
    """Sold and unsold substances as one table, the unsold ones at 0: a row per outlet again, with its launches."""
    k = TOP[LAUNCH]
    places = F.coalesce("unsold", F.array(*[F.lit(m).cast("bigint") for m in range(1, k + 1)]))
    spine = ranked_substances(domain).select("dci", F.col("rank").alias("place"))
    others = [c for c in figures.columns if c not in ("outlet_id", "sold", "unsold")]
    named = figures.select("outlet_id", F.struct("sold", *others).alias("rest"), F.explode(places).alias("place")).join(spine, "place", "left")
    whole = named.groupBy("outlet_id").agg(F.any_value("rest").alias("rest"), F.collect_list("dci").alias("names"))
    zero = F.lit(0).cast("bigint")
    none = F.lit(0).cast("decimal(20,2)")

    def row(share: Column, dci: Column, *counts: Column) -> Column:
        return F.struct((-share).alias("back"), dci.alias("dci"), *[c.alias(f"{s}_qty") for s, c in zip(SIDES, counts)])

    sold = F.transform(F.coalesce("rest.sold", F.array()), lambda r: row(r["share"], r["dci"], *[r[f"{s}_qty"] for s in SIDES]))
    unsold = F.transform("names", lambda dci: row(none, dci, zero, zero, zero))
    first = F.slice(F.sort_array(F.concat(sold, unsold)), 1, k)

    def ranked(r: Column, i: Column) -> Column:
        share = (-r["back"]).cast("decimal(20,2)").alias("share")
        return F.struct((i + 1).alias("rank"), r["dci"].alias("dci"), share, *[r[f"{s}_qty"].alias(f"{s}_qty") for s in SIDES])

    launches = F.transform(first, ranked)
    return whole.select("outlet_id", *[F.col("rest")[c].alias(c) for c in others], F.when(F.size(launches) > 0, launches).alias("launches"))
