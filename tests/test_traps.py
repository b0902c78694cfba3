"""Hand-made tables, one per trap of the semantics."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from outletscope.constants import MOLECULE_RULES
from outletscope.operators import display, launches, molecules, offers, outlets
from outletscope.sources.domain import null_keys
from tests.tables import rows

AS_OF = date(2025, 6, 30)
LATER, EARLIER = date(2025, 12, 31), date(2025, 1, 1)
MONTH = 202505
D = Decimal


@pytest.fixture(params=["broadcast", "shuffle"])
def join_way(request, spark):
    """Both ways the fact meets the catalogue."""
    if request.param == "shuffle":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def offer(article, lab, link="L1", rebate="0.10", until=LATER, kind="G", price="10.00"):
    return (article, link, lab, D(rebate), until, kind, D(price))


def group(link="L1", group_id="G1", label="AMOX", price="20.00"):
    return (link, group_id, label, "BT12", None, None, D(price))


def leakage_tables(**changes):
    """Outlet 7 sold 3 of article 2, a competitor's; article 1 is the focus lab's."""
    tables = dict(
        sales=[(7, 2, MONTH, 3)],
        article=[(1, "F", "G", None), (2, "C", "G", None)],
        offer=[offer(1, "F"), offer(2, "C")],
        link_group=[group()],
        article_group=[(1, "G1"), (2, "G1")],
        lab=[("F", "Focus"), ("C", "Comp")],
        ean=[(101, 1), (102, 2)],
        outlet=[(7, "A", "1", "X"), (8, "B", "2", "Y")],
    )
    return tables | changes


# --- focus links and exclusion


def test_link_needs_a_running_offer(make_domain):
    for until, links in ((LATER, [("L1",)]), (AS_OF, []), (EARLIER, [])):
        d = make_domain(**leakage_tables(offer=[offer(1, "F", until=until)]))
        assert rows(offers.focus_links(d, "F", AS_OF), "link_id") == links


def test_best_rebate_and_exclusion(make_domain):
    tables = leakage_tables(offer=[offer(1, "F", rebate="0.30"), offer(2, "F", rebate="0.40")])
    assert rows(offers.focus_links(make_domain(**tables), "F", AS_OF)) == [("L1", D("0.40"))]
    tables["excluded_ean"] = [(102,)]
    assert rows(offers.focus_links(make_domain(**tables), "F", AS_OF)) == [("L1", D("0.30"))]


def test_null_exclusion_key_stops_the_job(make_domain):
    d = make_domain(**leakage_tables(excluded_ean=[(102,), (None,)]))
    with pytest.raises(Exception, match="excluded_ean.ean"):
        offers.focus_links(d, "F", AS_OF).collect()


def test_null_keys_are_counted(spark, make_domain):
    found = null_keys(make_domain(sales=[(None, 1, MONTH, 1), (1, 1, MONTH, 1)])).filter("nulls > 0")
    assert rows(found) == [("sales", 2, "outlet_id", 1)]


# --- switches


def test_switch_counts_every_offer_even_expired(make_domain, join_way):
    both = [offer(1, "F"), offer(2, "C", price="10.00"), offer(2, "C", until=EARLIER, price="12.00")]
    d = make_domain(**leakage_tables(offer=both))
    top = offers.top_switch(d, "F", AS_OF, MONTH)
    assert rows(top, "label", "lab_name", "qty", "value", "rank") == [("AMOX BT12", "Comp", 6, D("66.00"), 1)]
    assert rows(offers.switch_total(d, "F", AS_OF, MONTH)) == [(7, D("66.00")), (8, D("0.00"))]


def test_switch_needs_an_active_generic(make_domain):
    for stopped, kind, n in ((None, "G", 1), (EARLIER, "G", 0), (None, "A", 0)):
        d = make_domain(**leakage_tables(article=[(1, "F", kind, stopped), (2, "C", "P", None)]))
        assert offers.top_switch(d, "F", AS_OF, MONTH).count() == n


def test_unknown_lab_stays_and_null_lab_goes(make_domain):
    d = make_domain(**leakage_tables(offer=[offer(1, "F"), offer(2, "Z")]))
    assert rows(offers.top_switch(d, "F", AS_OF, MONTH), "lab_name", "qty") == [(None, 3)]
    d = make_domain(**leakage_tables(offer=[offer(1, "F"), offer(2, None)]))
    assert offers.top_switch(d, "F", AS_OF, MONTH).count() == 0


def test_missing_price_counts_in_quantity_only(make_domain, join_way):
    no_price = (2, "L1", "C", D("0.10"), LATER, "G", None)
    d = make_domain(**leakage_tables(offer=[offer(1, "F"), no_price]))
    assert rows(offers.top_switch(d, "F", AS_OF, MONTH), "qty", "value") == [(3, None)]
    assert rows(offers.switch_total(d, "F", AS_OF, MONTH)) == [(7, D("0.00")), (8, D("0.00"))]


def test_ties_have_a_stable_choice(make_domain):
    d = make_domain(
        **leakage_tables(
            sales=[(7, a, MONTH, 1) for a in (2, 3, 4)],
            offer=[offer(1, "F", link) for link in ("L1", "L2", "L3")]
            + [offer(2, "C", "L1"), offer(3, "C", "L2"), offer(4, "C", "L3")],
            link_group=[group("L1", "G1", "C"), group("L2", "G1", "A"), group("L3", "G1", "B")],
        )
    )
    assert rows(offers.top_switch(d, "F", AS_OF, MONTH, k=2), "rank", "label") == [(1, "A BT12"), (2, "B BT12")]


def test_originator_uses_group_price_and_article_maker(make_domain, join_way):
    d = make_domain(
        **leakage_tables(
            article=[(1, "F", "G", EARLIER), (2, "M", "P", None)],
            offer=[offer(1, "F"), offer(2, "F", kind="P")],
            lab=[("F", "Focus"), ("M", "Maker")],
        )
    )
    top = offers.top_originator(d, "F", AS_OF, MONTH)
    assert rows(top, "lab_name", "qty", "value") == [("Maker", 3, D("60.00"))]
    totals = offers.margin_total(d, "F", AS_OF, MONTH)
    assert rows(totals) == [(7, D("0.00"), D("60.00"), D("60.00")), (8, D("0.00"), D("0.00"), D("0.00"))]


def test_originator_without_known_maker_is_left_out(make_domain):
    d = make_domain(**leakage_tables(offer=[offer(1, "F"), offer(2, "C", kind="P")], lab=[("F", "Focus")]))
    assert offers.top_originator(d, "F", AS_OF, MONTH).count() == 0


# --- launches


def launch_tables(sales, article, **changes):
    ids = sorted({a[0] for a in article})
    tables = dict(
        sales=sales,
        article=article,
        article_group=[(i, f"G{i}") for i in ids],
        dci=[(f"G{i}", "ABC"[i - 1], None, None) for i in ids],
        ean=[(100 + i, i) for i in ids],
        launch_ean=[(100 + i,) for i in ids],
        outlet=[(7, "A", "1", "X"), (8, "B", "2", "Y")],
    )
    return tables | changes


def test_launch_share_is_cut_and_zero_filled(make_domain, join_way):
    d = make_domain(
        **launch_tables(
            [(7, 1, MONTH, 2), (7, 2, MONTH, 5)],
            [(1, "F", "G", None), (2, "C", "G", None), (3, "C", "P", None)],
            dci=[("G1", "x", None, None), ("G2", "x", None, None), ("G3", "y", None, None)],
        )
    )
    card = launches.launch_scorecard(d, "F", MONTH, MONTH)
    zero = (D("0.00"), 0, 0, 0)
    assert rows(card) == [(7, 1, "x", D("28.57"), 2, 5, 0), (7, 2, "y", *zero), (8, 1, "x", *zero), (8, 2, "y", *zero)]


def test_launch_share_may_exceed_100(make_domain):
    d = make_domain(
        **launch_tables(
            [(7, 1, MONTH, 2), (7, 2, MONTH, 3)],
            [(1, "F", "G", None), (2, "F", "P", None)],
            dci=[("G1", "x", None, None), ("G2", "x", None, None)],
        )
    )
    assert rows(launches.launch_scorecard(d, "F", MONTH, MONTH).filter("outlet_id = 7"), "share", "focus_qty", "originator_qty") == [
        (D("250.00"), 5, 3)
    ]


def test_launch_fill_is_exact_around_k(make_domain):
    article = [(1, "F", "G", None), (2, "F", "G", None), (3, "F", "G", None)]
    sold_b = make_domain(**launch_tables([(7, 2, MONTH, 1)], article))
    card = launches.launch_scorecard(sold_b, "F", MONTH, MONTH, k=2)
    assert rows(card, "outlet_id", "rank", "dci") == [(7, 1, "B"), (7, 2, "A"), (8, 1, "A"), (8, 2, "B")]
    # a net return ranks below the substances without sales
    returned = make_domain(**launch_tables([(7, 1, MONTH, -1), (7, 1, MONTH, 0)], [(1, "F", "P", None), *article[1:]]))
    card = launches.launch_scorecard(returned, "F", MONTH, MONTH, k=3)
    assert rows(card.filter("outlet_id = 7"), "rank", "dci", "focus_qty") == [(1, "A", -1), (2, "B", 0), (3, "C", 0)]


def test_several_substances_of_a_group_each_count(make_domain):
    d = make_domain(
        **launch_tables([(7, 1, MONTH, 2)], [(1, "F", "G", None)], dci=[("G1", "x", "5", None), ("G1", "x", "9", None)])
    )
    assert rows(launches.launch_sales(d, "F", MONTH, MONTH), "focus_qty") == [(4,)]


def test_unknown_maker_counts_in_the_total_only(make_domain):
    d = make_domain(
        **launch_tables(
            [(7, 1, MONTH, 1), (7, 2, MONTH, 1)],
            [(1, "F", "G", None), (2, None, "G", None)],
            dci=[("G1", "x", None, None), ("G2", "x", None, None)],
        )
    )
    sold = launches.launch_sales(d, "F", MONTH, MONTH)
    assert rows(sold, "share", "focus_qty", "competitor_qty") == [(D("50.00"), 1, 0)]


# --- molecules


def molecule_tables(**changes):
    tables = dict(
        collection=[(7, 1, MONTH, 2), (7, 2, MONTH, 3), (7, 2, 202504, 5)],
        article=[(1, "F", "B", None), (2, "C", "R", None)],
        lab=[("F", "Focus"), ("C", "Comp")],
        article_group=[(1, "G1"), (2, "G1")],
        dci=[("G1", "FILGRASTIM  ", "30 MU", None)],
        link_group=[group("L1", "G1", "Filgrastim 30")],
        regulated_price=[(1, D("10.00"), 1), (1, D("99.00"), 0), (2, D("20.00"), 1)],
        outlet=[(7, "A", "1", "X"), (8, "B", "2", "Y")],
    )
    return tables | changes


def molecule_row(card, outlet=7, sort_order=1):
    return rows(
        card.filter(f"outlet_id = {outlet} AND sort_order = {sort_order}"),
        "focus_qty", "other_qty", "focus_value", "other_value", "share",
    )


def test_molecule_scorecard(make_domain, join_way):
    card = molecules.molecule_scorecard(make_domain(**molecule_tables()), "F", MONTH)
    assert molecule_row(card) == [(2, 3, D("20.00"), D("60.00"), D("25.00"))]
    assert molecule_row(card, sort_order=999) == molecule_row(card)
    assert molecule_row(card, sort_order=2) == [(0, 0, D("0.00"), D("0.00"), D("0.00"))]
    assert molecule_row(card, outlet=8, sort_order=999) == [(0, 0, D("0.00"), D("0.00"), D("0.00"))]
    assert [r["molecule"] for r in card.filter("outlet_id = 8").orderBy("sort_order").collect()] == [
        *[rule.display for rule in MOLECULE_RULES],
        "TOTAL",
    ]


def test_molecule_range(make_domain):
    card = molecules.molecule_scorecard(make_domain(**molecule_tables()), "F", 202504, MONTH)
    assert molecule_row(card) == [(2, 8, D("20.00"), D("160.00"), D("11.11"))]


def test_unpriced_sales_count_in_quantity(make_domain, join_way):
    prices = [(1, D("10.00"), 1), (2, D("20.00"), 0)]
    card = molecules.molecule_scorecard(make_domain(**molecule_tables(regulated_price=prices)), "F", MONTH)
    assert molecule_row(card) == [(2, 3, D("20.00"), D("0.00"), D("100.00"))]


def test_molecule_filters(make_domain):
    empty = [(0, 0, D("0.00"), D("0.00"), D("0.00"))]
    for changes in (
        dict(article=[(1, "F", "G", None), (2, "C", "P", None)]),  # other types
        dict(link_group=[group("L1", "G1", "Other")]),  # label without prefix
        dict(dci=[("G1", "FILGRASTIM PEG", None, None)]),  # no rule
        dict(lab=[]),  # maker unknown
    ):
        card = molecules.molecule_scorecard(make_domain(**molecule_tables(**changes)), "F", MONTH)
        assert molecule_row(card, sort_order=999) == empty


def test_gap_only_below_the_target(make_domain):
    gap = molecules.share_gap(molecules.molecule_scorecard(make_domain(**molecule_tables()), "F", MONTH), (20, 30, 50))
    assert rows(gap.filter("outlet_id = 7")) == [(7, D("25.00"), D("0"), D("4.00"), D("20.00"))]
    assert rows(gap.filter("outlet_id = 8")) == [(8, D("0.00"), D("0"), D("0"), D("0"))]


# --- outlets


def eligible_tables(**changes):
    tables = dict(
        sales=[(7, 1, MONTH, 4), (7, 2, MONTH, 6), (1, 1, MONTH, 4)],
        offer=[offer(1, "F"), offer(2, "C")],
        completeness=[(7, MONTH, 1), (1, MONTH, 1)],
        outlet_group=[(7, 406), (1, 406)],
        crm=[(7, "P7")],
        outlet_master=[(7, "F7")],
        member=[("F7", "a@b")],
    )
    return tables | changes


def eligible(make_domain, **changes):
    d = make_domain(**eligible_tables(**changes))
    return rows(outlets.eligible_outlets(d, "F", MONTH, 406), "outlet_id", "code", "mail", "share")


def test_share_on_the_threshold_is_eligible(make_domain, join_way):
    assert eligible(make_domain) == [(7, "P7", "a@b", 0.4)]


@pytest.mark.parametrize(
    "changes",
    [
        dict(sales=[(7, 1, MONTH, 399), (7, 2, MONTH, 601)]),  # just below
        dict(completeness=[(7, MONTH, 1), (7, MONTH, 1)]),  # two complete rows
        dict(completeness=[(7, MONTH, 0)]),
        dict(completeness=[(7, 202504, 1)]),
        dict(outlet_group=[(7, 405)]),
        dict(sales=[(7, 1, MONTH, 4), (7, 1, MONTH, -4)]),  # potential 0
        dict(sales=[(7, 2, MONTH, 4)]),  # no focus sale
        dict(offer=[(1, "L1", "F", None, LATER, "G", None)]),  # no price at all
    ],
)
def test_not_eligible(make_domain, changes):
    assert eligible(make_domain, **changes) == []


def test_incomplete_rows_do_not_disqualify(make_domain):
    assert len(eligible(make_domain, completeness=[(7, MONTH, 1), (7, MONTH, 0)])) == 1


def test_contacts_fan_out_and_may_be_missing(make_domain):
    two = eligible(make_domain, crm=[(7, "P7"), (7, "P7b")])
    assert [r[1] for r in two] == ["P7", "P7b"]
    assert eligible(make_domain, crm=[]) == [(7, None, None, 0.4)]
    assert eligible(make_domain, member=[]) == [(7, "P7", None, 0.4)]


def test_wanted_outlets_only(spark, make_domain):
    d = make_domain(**eligible_tables())
    for wanted, n in (((7,), 1), ((9,), 0)):
        only = spark.createDataFrame([wanted], "outlet_id BIGINT")
        assert outlets.eligible_outlets(d, "F", MONTH, 406, wanted=only).count() == n


def test_unknown_outlet_has_no_label(spark, make_domain):
    d = make_domain(outlet=[(7, "A", "1", "X")])
    wanted = spark.createDataFrame([(7,), (9,)], "outlet_id BIGINT")
    assert rows(outlets.outlet_labels(d, wanted)) == [(7, "Pharmacie A - 1  X"), (9, None)]


# --- display


def test_placeholder_for_an_outlet_without_rows(make_domain):
    d = make_domain(**leakage_tables())
    shown = display.display_switch(d.outlet, offers.top_switch(d, "F", AS_OF, MONTH))
    assert rows(shown, "outlet_id", "label_text", "qty_text", "value_text", "has_data", "message") == [
        (7, "Amox bt12", "3", "30.00€", True, None),
        (8, None, None, None, False, "Aucune donnée disponible pour ce mois."),
    ]


def test_long_names_are_cut_before_capitalising(spark):
    top = spark.createDataFrame(
        [(7, 1, "A" * 90, "LABORATOIRE DE TRES LONG NOM", 2, D("1.5"))],
        "outlet_id BIGINT, rank INT, label STRING, lab_name STRING, qty BIGINT, value DECIMAL(20,2)",
    )
    shown = display.display_originator(top.select("outlet_id"), top).first()
    assert shown["label_text"] == "A" + "a" * 79 + " "
    assert shown["lab_text"] == "Laboratoire de tres long  "
    assert shown["value_text"] == "1.50€"
