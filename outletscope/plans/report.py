"""The monthly report: one row per eligible outlet, its status, and the summary of the run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletscope import constants as C
from outletscope.functions.numbers import from_cents, money_ratio, share_fits
from outletscope.functions.periods import month_label, since, trailing_months
from outletscope.operators.figures import Months, outlet_figures, with_launches
from outletscope.operators.molecules import card_rows, gap_columns
from outletscope.operators.outlets import complete_outlets, contacts, outlet_labels
from outletscope.sources.domain import Domain
from outletscope.sources.tables import stored


@dataclass(frozen=True)
class ReportParams:
    """What a run reports on; ``period`` is the month before the run."""

    as_of: date
    period: int
    since_period: int = C.SINCE_PERIOD
    focus_lab: str = C.FOCUS_LAB
    group_no: int = C.REPORT_GROUP
    min_share: float = C.MIN_SHARE
    months: int = C.TRAILING_MONTHS
    targets: Sequence[float] = C.GAP_TARGETS
    rules: Sequence[C.MoleculeRule] = C.MOLECULE_RULES
    prefixes: Sequence[str] = C.GROUP_PREFIXES


def total_gaps(molecules: str, targets: Sequence[float], suffix: str = "") -> list[Column]:
    """Gap columns out of the total row of a nested molecule table."""
    total = F.filter(molecules, lambda row: row["is_total"])[0]
    return gap_columns(total["share"], total["focus_value"], total["other_value"], targets, suffix)


def report_months(params: ReportParams) -> Months:
    trailing_start, end = trailing_months(params.period, params.months)
    return Months(params.period, trailing_start, since(params.since_period, end)[0])


def candidates(domain: Domain, params: ReportParams, wanted: DataFrame | None = None) -> DataFrame:
    """Outlets that qualify by all but their sales: complete in the month, in the group, wanted."""
    members = domain.outlet_group.filter(F.col("group_no") == params.group_no).select("outlet_id")
    found = complete_outlets(domain, params.period).filter(F.col("outlet_id") > C.MIN_OUTLET_ID)
    found = found.join(members, "outlet_id", "left_semi")
    return found if wanted is None else found.join(wanted, "outlet_id", "left_semi")


def figures_of(domain: Domain, params: ReportParams, outlets: DataFrame) -> DataFrame:
    """The figures of some outlets, from one pass over the sales."""
    p = params
    return outlet_figures(domain.for_outlets(outlets), report_months(p), p.focus_lab, p.as_of, p.rules, p.prefixes)


def qualified(figures: DataFrame, params: ReportParams) -> DataFrame:
    share = money_ratio(F.col("offer_focus_cents"), F.col("offer_month_cents"))
    return figures.filter(F.col("sold_focus") & (share >= params.min_share))


def completed(figures: DataFrame, domain: Domain, params: ReportParams) -> DataFrame:
    """Label, totals and molecule tables of outlets; a known outlet without sales has zeros, an unknown one nothing."""
    known = outlet_labels(domain).withColumn("known", F.lit(True))
    rows = figures.join(known, "outlet_id", "left")
    zero = F.lit(0).cast("bigint")
    cents = {name: F.coalesce(f"{name}_month_cents", zero) for name in ("switch", "originator")}
    both = F.try_add(cents["switch"], cents["originator"])
    fault = F.coalesce("fault", F.lit(False))

    def money(amount: Column) -> Column:
        return F.when(F.col("known") & ~fault, from_cents(amount))

    def card(suffix: str) -> Column:
        return F.when(F.col("known") & ~fault, card_rows(sorted(params.rules), suffix))

    return rows.withColumns(
        {
            "fault": fault,
            "switch_total": money(cents["switch"]),
            "originator_total": money(cents["originator"]),
            "margin": money(both),
            "molecules": card(""),
            "molecules_since": card("_since"),
        }
    )


def report_dataset(
    domain: Domain, params: ReportParams, wanted: DataFrame | None = None, folder: str | None = None
) -> DataFrame:
    """One row per eligible outlet and contact with all the report shows.

    Nothing runs until the result is used, and then the sales are read once. With a ``folder`` that all executors share,
    new and the caller's to remove, the outlets' figures are stored there first. The number of jobs does not depend on
    the number of outlets.
    """
    p = params
    figures = qualified(figures_of(domain, p, candidates(domain, p, wanted)), p)
    if folder:
        figures = stored(figures, f"{folder}/figures")
    rows = completed(with_launches(figures, domain), domain, p).join(contacts(domain), "outlet_id", "left")

    def table(name: str) -> Column:
        return F.when(F.size(name) > 0, F.col(name)).alias(name)

    return rows.select(
        "outlet_id",
        "code",
        "mail",
        F.lit(p.period).alias("period"),
        month_label(F.lit(p.period)).alias("month"),
        "label",
        "switch_total",
        "originator_total",
        "margin",
        table("top_switch"),
        table("top_originator"),
        F.when(F.col("known"), F.col("launches")).alias("launches"),
        "molecules",
        "molecules_since",
        *total_gaps("molecules", p.targets),
        *total_gaps("molecules_since", p.targets, "_since"),
        "fault",
    )


SECTIONS = {
    "top_switch": ("rank", "label", "qty", "value", ("lab_name", "rebate")),
    "top_originator": ("rank", "label", "qty", "value", ("lab_name",)),
    "launches": ("rank", "dci", "focus_qty", "share", ("competitor_qty", "originator_qty")),
    "molecules": ("sort_order", "molecule", "focus_qty", "share", ("other_qty", "focus_value", "other_value")),
    "molecules_since": ("sort_order", "molecule", "focus_qty", "share", ("other_qty", "focus_value", "other_value")),
}


def report_rows(report: DataFrame) -> DataFrame:
    """The tables of the report as rows: section, position, name, quantity, amount (value or share), and the other
    columns of the section as text (``more``)."""

    def section(name: str) -> Column:
        def row(r: Column) -> Column:
            *main, more = SECTIONS[name]
            position, label, qty, amount = (r[c] for c in main)
            texts = [F.coalesce(r[c].cast("string"), F.lit("")) for c in more]
            return F.struct(
                F.lit(name).alias("section"),
                position.cast("int").alias("position"),
                label.alias("name"),
                qty.alias("qty"),
                amount.cast("double").alias("amount"),
                F.concat_ws("|", *texts).alias("more"),
            )

        return F.transform(F.coalesce(name, F.array()), row)

    return report.select("outlet_id", "period", F.inline(F.concat(*[section(name) for name in SECTIONS])))


def status_inputs(domain: Domain, params: ReportParams, asked: DataFrame | None = None) -> DataFrame:
    """What the status of a report follows from: contact, label, total and share of each outlet of the run.

    ``asked``: outlets and their mail, if not the eligible ones.
    """
    p = params
    if asked is None:
        figures = qualified(figures_of(domain, p, candidates(domain, p)), p)
        asked = contacts(domain).select("outlet_id", "mail")
        rows = figures.join(asked, "outlet_id", "left")
    else:
        rows = asked.join(figures_of(domain, p, asked), "outlet_id", "left")
    share = F.filter("molecules", lambda row: row["is_total"])[0]["share"]
    found = completed(rows, domain, p)
    period = F.lit(p.period).alias("period")
    return found.select("outlet_id", "mail", period, "label", "switch_total", "originator_total", "margin", share.alias("total_share"), "fault")


def run_status(report: DataFrame) -> DataFrame:
    """Whether each report can be sent: OK, or the first thing it lacks. An outlet's fault stays its own."""
    fault = F.col("fault") if "fault" in report.columns else F.lit(False)
    reason = (
        F.when(F.col("label").isNull(), "outlet not found")
        .when(F.col("mail").isNull(), "no mail address")
        .when(fault, "amount out of range")
        .when(F.col("margin").isNull(), "totals missing")
        .when(~share_fits(F.col("total_share")), "share out of range")
    )
    status = F.when(reason.isNull(), C.STATUS_OK).otherwise(F.concat(F.lit(f"{C.STATUS_ERROR}: "), reason))
    return report.select("outlet_id", "period", "mail", status.alias("status"))


def is_error() -> Column:
    return F.col("status").contains(C.STATUS_ERROR)


def run_summary(status: DataFrame, run_day: date) -> DataFrame:
    """Counts of a run and its summary text, also for a run without outlets; a run without errors says so.

    The lines of ``error_lines``, in order, complete the text of a run with errors.
    """
    counts = status.agg(F.count_if(F.col("status") == C.STATUS_OK).alias("n_ok"), F.count_if(is_error()).alias("n_err"))
    head = F.format_string(C.SUMMARY_TEXT, F.lit(run_day.isoformat()), "n_ok", "n_err")
    none = F.when(F.col("n_err") == 0, C.NO_ERROR_TEXT).otherwise("")
    return counts.withColumn("text", F.concat(head, none))


def error_lines(status: DataFrame) -> DataFrame:
    """The error lines of a run, one row each; their order is that of the outlets."""
    line = F.concat(
        F.lit("ID="),
        F.col("outlet_id").cast("string"),
        F.lit(" | Email="),
        F.coalesce("mail", F.lit("NA")),
        F.lit(" | Statut="),
        F.col("status"),
    )
    return status.filter(is_error()).select("period", "outlet_id", line.alias("line"))
