"""Registered queries: every operator over the star schema, for the driver, the tests and the bench."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType

from outletscope.constants import TRAILING_MONTHS
from outletscope.functions.numbers import from_cents, share_band
from outletscope.functions.periods import month_key, trailing_months
from outletscope.functions.text import capitalise, cut_text
from outletscope.operators import areas as area_ops
from outletscope.operators import calendar, display, launches, molecules, offers, outlets, rules, windows
from outletscope.operators.hot import frequent
from outletscope.operators.joins import in_period, sell
from outletscope.plans import artefact
from outletscope.plans import report as reports
from outletscope.sources import star
from outletscope.sources.domain import Domain, load_domain, null_keys, observed_keys, observed_nulls
from outletscope.sources.layout import write_bucketed
from outletscope.sources.session import shared_folder
from outletscope.sources.tables import summed_by_month, write_monthly_sales

Query = Callable[[SparkSession, str], DataFrame]

START, END = 199801, 199812
MONTH = 199806
SINCE = 199803
REPORT_MIN_SHARE = 0.03

LAB, AS_OF = star.FOCUS_LAB, star.AS_OF


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, so that engines compare alike."""

    def column(field):
        c = F.col(field.name)
        if isinstance(field.dataType, DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, DateType):
            return c.cast("string").alias(field.name)
        return c

    return df.select(*[column(field) for field in df.schema.fields])


def order_days(spark: SparkSession, directory: str) -> DataFrame:
    """Every day with orders, and how many."""
    day = F.col("o_orderdate").cast("date").alias("day")
    return star.table(spark, directory, "orders").groupBy(day).agg(F.count("*").alias("orders"))


def order_months(spark: SparkSession, directory: str) -> DataFrame:
    period = month_key(F.col("o_orderdate")).alias("period")
    return star.table(spark, directory, "orders").groupBy(period).agg(F.count("*").alias("orders"))


def year(spark, directory, outlet_by="nation") -> Domain:
    return star.load_star(spark, directory, START, END, outlet_by)


def month(spark, directory) -> Domain:
    return star.load_star(spark, directory, MONTH, MONTH)


# --- calendar -------------------------------------------------------------------


def month_keys(spark, directory):
    return calendar.month_keys(order_days(spark, directory))


def period_windows(spark, directory):
    return calendar.period_windows(order_months(spark, directory), SINCE)


def send_dates(spark, directory):
    months = order_months(spark, directory)
    at_17 = calendar.send_dates(months, star.HOLIDAYS).withColumnRenamed("send_date", "send_date_17")
    return calendar.send_dates(at_17, star.HOLIDAYS, day=10).withColumnRenamed("send_date", "send_date_10")


def business_days(spark, directory):
    return calendar.business_days(order_days(spark, directory), star.HOLIDAYS)


def business_calendar(spark, directory):
    return calendar.business_calendar(order_days(spark, directory), star.holidays(spark, directory))


def calendar_send_dates(spark, directory):
    """Send dates by a table of holidays."""
    planned = calendar.planned_days(order_months(spark, directory))
    return calendar.rolled_forward(planned, star.holidays(spark, directory)).withColumnRenamed("business_day", "send_date")


# --- tables ---------------------------------------------------------------------


def key_checks(spark, directory):
    return null_keys(star.load_star(spark, directory))


def loaded_key_checks(spark, directory):
    """The same checks on tables that went through the loader: typed, trimmed, catalogue keys checked."""
    raw = star.load_star(spark, directory)
    return null_keys(load_domain(raw.table))


def monthly_sales(spark, directory):
    return summed_by_month(star.load_star(spark, directory).sales)


def observed_key_checks(spark, directory):
    """NULL keys of the sales, counted by the job that stores them by month."""
    domain, seen = observed_keys(star.load_star(spark, directory))
    write_monthly_sales(domain.sales, f"{shared_folder(spark)}/sales-{uuid.uuid4().hex}")
    return observed_nulls(spark, seen)


def in_buckets(spark, directory, buckets=8) -> dict[str, DataFrame]:
    """Lines and orders in tables of their own, bucketed on the order key."""
    run = uuid.uuid4().hex
    keys = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
    folder = f"{shared_folder(spark)}/buckets-{run}"
    return {
        name: write_bucketed(star.table(spark, directory, name), f"{name}_{run}", f"{folder}/{name}", key, buckets)
        for name, key in keys.items()
    }


def bucketed_top_switch(spark, directory):
    """Top switches from lines and orders that meet bucket by bucket."""
    d = star.load_star(spark, directory, START, END, "customer", in_buckets(spark, directory))
    return offers.top_switch(d, LAB, AS_OF, START, END)


# --- outlets --------------------------------------------------------------------


def outlet_labels(spark, directory, outlet_by="nation"):
    return outlets.outlet_labels(star.load_star(spark, directory, outlet_by=outlet_by))


def outlet_numbers(spark, directory):
    """Numbers out of the orders, beyond those of the outlets."""
    return star.table(spark, directory, "orders").select((F.col("o_custkey") % 40).alias("outlet_id")).distinct()


def wanted_labels(spark, directory):
    """Labels of outlets asked for by number, also of those that do not exist."""
    return outlets.outlet_labels(star.load_star(spark, directory), outlet_numbers(spark, directory))


def long_labels(spark, directory):
    """Texts beyond the display widths are cut."""
    text = F.concat_ws(" ", *["p_name", "p_brand"] * 5)
    cut = [cut_text(capitalise(text), width).alias(f"cut_{width}") for width in (80, 25)]
    return star.table(spark, directory, "part").select(F.col("p_partkey").alias("article_id"), *cut)


def contact_list(spark, directory):
    return outlets.contacts(star.load_star(spark, directory, outlet_by="customer"))


def eligible_outlets(spark, directory):
    return outlets.eligible_outlets(month(spark, directory), LAB, MONTH, star.REPORT_GROUP, star.MIN_SHARE)


def wanted_outlets(spark, directory):
    """Eligible outlets out of a given list."""
    d = month(spark, directory)
    even = d.outlet.filter(F.col("outlet_id") % 2 == 0).select("outlet_id")
    return outlets.eligible_outlets(d, LAB, MONTH, star.REPORT_GROUP, REPORT_MIN_SHARE, wanted=even)


def focus_potential(spark, directory):
    d = star.load_star(spark, directory, MONTH, MONTH, "customer")
    cents = ("focus_cents", "cents")
    money = [from_cents(F.col(c)).alias(c.replace("cents", "value")) for c in cents]
    return outlets.focus_potential(d, LAB, MONTH).select("outlet_id", *money, "sold_focus")


def complete_months(spark, directory):
    """HAVING: outlet months with exactly one complete row."""
    complete = star.load_star(spark, directory).completeness.filter("ok = 1")
    return complete.groupBy("outlet_id", "period").agg(F.sum("ok").alias("n")).filter("n = 1").drop("n")


# --- leakage --------------------------------------------------------------------


def focus_links(spark, directory):
    return offers.focus_links(year(spark, directory), LAB, AS_OF)


def not_in_exclusion(spark, directory):
    """NOT IN: offers of articles that are not on the exclusion list, per lab."""
    d = year(spark, directory)
    kept = d.offer.join(offers.excluded_articles(d), "article_id", "left_anti")
    return kept.groupBy("lab").agg(F.count("*").alias("offers"), F.sum("price").alias("price"))


def top_switch(spark, directory, outlet_by="nation"):
    return offers.top_switch(year(spark, directory, outlet_by), LAB, AS_OF, START, END)


def top_originator(spark, directory, outlet_by="nation"):
    return offers.top_originator(year(spark, directory, outlet_by), LAB, AS_OF, START, END)


def leakage_total(spark, directory, total, outlet_by="nation"):
    return total(year(spark, directory, outlet_by), LAB, AS_OF, START, END)


def hot_articles(spark, directory) -> DataFrame:
    lines = star.table(spark, directory, "lineitem")
    return frequent(lines.select(F.col("l_partkey").alias("article_id")), "article_id")


def split_query(spark, directory, operator):
    """Sums of articles sold often are dealt over many tasks."""
    hot = hot_articles(spark, directory)
    return operator(year(spark, directory, "customer"), LAB, AS_OF, START, END, hot=hot)


# --- scorecards -----------------------------------------------------------------


def launch_scorecard(spark, directory, outlet_by="nation"):
    first, last = trailing_months(MONTH, TRAILING_MONTHS)
    return launches.launch_scorecard(star.load_star(spark, directory, first, last, outlet_by), LAB, first, last)


def molecule_class(spark, directory):
    return molecules.classified_substances(year(spark, directory), star.RULES)


def molecule_card(spark, directory, start, end, outlet_by="nation"):
    d = star.load_star(spark, directory, start, end, outlet_by)
    return molecules.molecule_scorecard(d, LAB, start, end, star.RULES, star.PREFIXES)


def part_names(spark, directory) -> DataFrame:
    name = F.concat("p_name", F.lit("#"), F.col("p_size").cast("string"))
    return star.table(spark, directory, "part").select(F.col("p_partkey").alias("article_id"), name.alias("name"))


def first_rules(spark, directory):
    """Each part's first rule, out of as many rules as there are parts."""
    word = [F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2)]
    include = F.concat(word[1], F.lit("#"), (F.col("p_size") % 10).cast("string"))
    table = star.table(spark, directory, "part").select(
        F.col("p_partkey").alias("sort_order"), include.alias("include"), word[0].alias("exclude")
    )
    return rules.first_rules(part_names(spark, directory), "name", table)


def starting_with(spark, directory):
    """Parts whose name starts like that of a large part, up to a letter of its second word or two."""
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    large = star.table(spark, directory, "part").filter("p_size >= 49")
    prefix = F.substr("p_name", F.lit(1), F.char_length(word) + F.col("p_size") - F.lit(47))
    return rules.starting_with(part_names(spark, directory), "name", large.select(prefix.alias("prefix")))


def share_gap(spark, directory):
    return molecules.share_gap(molecule_card(spark, directory, START, END))


def bands(spark, directory):
    card = molecule_card(spark, directory, START, END, "customer")
    return card.select("outlet_id", "molecule", "share", share_band(F.col("share")).alias("band"))


def launch_windows(spark, directory):
    first, _ = trailing_months(START, TRAILING_MONTHS)
    return windows.launch_windows(star.load_star(spark, directory, first, END), LAB, START, END)


def molecule_windows(spark, directory, n=TRAILING_MONTHS):
    first, _ = trailing_months(SINCE, n or 1)
    d = star.load_star(spark, directory, first, END)
    return windows.molecule_windows(d, LAB, SINCE, END, n, star.RULES, star.PREFIXES)


def left_join_on_predicate(spark, directory):
    """The price condition belongs to the join: unpriced sales count in quantity, not in value."""
    d = year(spark, directory)
    priced = molecules.with_active_price(d.article, d).select("article_id", "price_cents")
    return (
        sell(in_period(d.sales, START, END), priced)
        .groupBy("outlet_id")
        .agg(
            F.sum("qty").alias("qty"),
            F.sum(F.when(F.col("price_cents").isNull(), F.col("qty"))).alias("unpriced_qty"),
            from_cents(F.sum(F.col("qty") * F.col("price_cents"))).alias("value"),
        )
    )


def total_row(spark, directory):
    """Rollup over all years: quantity per outlet and maker, per outlet, and overall."""
    d = star.load_star(spark, directory)
    sold = sell(d.sales, d.article.select("article_id", "maker_lab"))
    rolled = sold.rollup("outlet_id", "maker_lab").agg(F.grouping_id().alias("level"), F.sum("qty").alias("qty"))
    return rolled.select("outlet_id", "maker_lab", F.col("level").cast("int").alias("level"), "qty")


def sql_with_parameters(spark, directory):
    """The domain in SQL: views, and values bound by name instead of spliced into the text."""
    year(spark, directory).create_views("star_")
    return spark.sql(
        """
        SELECT s.outlet_id, l.lab_name, sum(s.qty) AS qty, sum(s.qty * o.price) AS value
        FROM star_sales s
        JOIN star_offer o ON o.article_id = s.article_id
        LEFT JOIN star_lab l ON l.lab = o.lab
        WHERE s.period BETWEEN :start AND :end AND o.lab NOT IN (:focus_lab) AND o.valid_until > :as_of
        GROUP BY s.outlet_id, l.lab_name
        """,
        args={"start": START, "end": END, "focus_lab": LAB, "as_of": AS_OF},
    )


# --- display --------------------------------------------------------------------


def display_switch(spark, directory):
    d = star.load_star(spark, directory, MONTH, MONTH, "customer")
    return display.display_switch(d.outlet, offers.top_switch(d, LAB, AS_OF, MONTH))


def display_originator(spark, directory):
    d = star.load_star(spark, directory, MONTH, MONTH, "customer")
    return display.display_originator(d.outlet, offers.top_originator(d, LAB, AS_OF, MONTH))


def display_launch(spark, directory):
    d = star.load_star(spark, directory)
    return display.display_launch(d.outlet, launch_scorecard(spark, directory))


def display_molecules(spark, directory):
    d = star.load_star(spark, directory)
    return display.display_molecules(d.outlet, molecule_card(spark, directory, START, END))


def display_gaps(spark, directory):
    return display.display_gaps(share_gap(spark, directory))


def display_totals(spark, directory):
    return display.display_totals(leakage_total(spark, directory, offers.margin_total))


# --- report ---------------------------------------------------------------------

REPORT = reports.ReportParams(
    as_of=AS_OF,
    period=MONTH,
    since_period=SINCE,
    focus_lab=LAB,
    group_no=star.REPORT_GROUP,
    min_share=REPORT_MIN_SHARE,
    rules=star.RULES,
    prefixes=star.PREFIXES,
)


def report_dataset(spark, directory):
    first, last = trailing_months(MONTH, TRAILING_MONTHS)
    return reports.report_dataset(star.load_star(spark, directory, min(first, SINCE), last), REPORT)


def report_flat(spark, directory):
    return reports.report_rows(report_dataset(spark, directory))


def report_totals(spark, directory):
    report = report_dataset(spark, directory)
    return report.select(*[f.name for f in report.schema.fields if f.dataType.typeName() not in ("array", "boolean")])


def report_committed(spark, directory):
    """The totals of a report that was committed to a folder of its own and read back."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    artefact.commit_report(report_dataset(spark, directory), path, MONTH)
    report = artefact.read_report(spark, path, MONTH)
    return report.select(*[f.name for f in report.schema.fields if f.dataType.typeName() not in ("array", "boolean")])


def run_status(spark, directory):
    return reports.run_status(reports.status_inputs(month(spark, directory), REPORT))


def run_summary(spark, directory):
    return reports.run_summary(run_status(spark, directory), AS_OF)


def error_text(spark, directory):
    """Error lines of a run over given outlet numbers, some of which do not exist or have no address."""
    d = month(spark, directory)
    asked = outlet_numbers(spark, directory).join(outlets.contacts(d).select("outlet_id", "mail"), "outlet_id", "left")
    return reports.error_lines(reports.run_status(reports.status_inputs(d, REPORT, asked)))


# --- areas ----------------------------------------------------------------------


def area_query(spark, directory, operator):
    return operator(star.areas(spark, directory))


def population_corr(spark, directory):
    result = area_ops.population_correlation(star.areas(spark, directory))
    rounded = [F.round(c, 6).alias(c) for c in ("correlation", "slope", "intercept")]
    return result.select("areas", *rounded)


_QUERIES: dict[str, Query] = {
    "month_keys": month_keys,
    "period_windows": period_windows,
    "send_dates": send_dates,
    "business_days": business_days,
    "business_calendar": business_calendar,
    "calendar_send_dates": calendar_send_dates,
    "key_checks": key_checks,
    "loaded_key_checks": loaded_key_checks,
    "monthly_sales": monthly_sales,
    "observed_key_checks": observed_key_checks,
    "outlet_labels": outlet_labels,
    "outlet_labels_customers": partial(outlet_labels, outlet_by="customer"),
    "wanted_labels": wanted_labels,
    "long_labels": long_labels,
    "contact_list": contact_list,
    "eligible_outlets": eligible_outlets,
    "wanted_outlets": wanted_outlets,
    "focus_potential": focus_potential,
    "having_exactly_one": complete_months,
    "focus_links": focus_links,
    "not_in_exclusion": not_in_exclusion,
    "top_switch": top_switch,
    "top_switch_customers": partial(top_switch, outlet_by="customer"),
    "top_originator": top_originator,
    "top_originator_customers": partial(top_originator, outlet_by="customer"),
    "switch_total": partial(leakage_total, total=offers.switch_total),
    "originator_total": partial(leakage_total, total=offers.originator_total),
    "margin_total": partial(leakage_total, total=offers.margin_total),
    "margin_total_customers": partial(leakage_total, total=offers.margin_total, outlet_by="customer"),
    "bucketed_top_switch": bucketed_top_switch,
    "split_top_switch": partial(split_query, operator=offers.top_switch),
    "split_top_originator": partial(split_query, operator=offers.top_originator),
    "split_margin_total": partial(split_query, operator=offers.margin_total),
    "launch_scorecard": launch_scorecard,
    "launch_scorecard_customers": partial(launch_scorecard, outlet_by="customer"),
    "molecule_class": molecule_class,
    "first_rules": first_rules,
    "starting_with": starting_with,
    "molecule_month": partial(molecule_card, start=MONTH, end=MONTH),
    "molecule_range": partial(molecule_card, start=START, end=END),
    "molecule_range_customers": partial(molecule_card, start=START, end=END, outlet_by="customer"),
    "launch_windows": launch_windows,
    "molecule_windows": molecule_windows,
    "molecule_since_windows": partial(molecule_windows, n=None),
    "share_gap": share_gap,
    "share_band": bands,
    "left_join_on_predicate": left_join_on_predicate,
    "total_row": total_row,
    "sql_with_parameters": sql_with_parameters,
    "display_switch": display_switch,
    "display_originator": display_originator,
    "display_launch": display_launch,
    "display_molecules": display_molecules,
    "display_gaps": display_gaps,
    "display_totals": display_totals,
    "report_flat": report_flat,
    "report_totals": report_totals,
    "report_committed": report_committed,
    "run_status": run_status,
    "run_summary": run_summary,
    "error_text": error_text,
    "outlet_quota": partial(area_query, operator=area_ops.outlet_quota),
    "quota_gap": partial(area_query, operator=area_ops.quota_gap),
    "population_corr": population_corr,
    "density_bands": partial(area_query, operator=area_ops.density_bands),
}


def _plain_query(query: Query) -> Query:
    return lambda spark, directory: plain(query(spark, directory))


QUERIES: dict[str, Query] = {name: _plain_query(query) for name, query in _QUERIES.items()}
