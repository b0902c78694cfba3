"""Random small domains, with NULLs, duplicates, returns and unknown keys, against plain SQL."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

import duckdb
import pyarrow as pa
import pytest

from outletscope.operators import launches, molecules, offers, outlets
from outletscope.plans import oracle
from outletscope.plans.queries import AS_OF, END, LAB, MONTH, START, plain
from outletscope.sources import star
from outletscope.sources.schemas import SCHEMAS
from tests.tables import rows

LABS = ["Brand#1", "Brand#2", "Brand#3", "Brand#4"]
WORDS = ["rod", "ring", "bolt", "gear", "widget", "anvil", "RODding"]
ARTICLES, OUTLETS, GROUPS = range(1, 25), range(1, 9), [f"g{i}" for i in range(8)]
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "date": pa.date32()}


def random_tables(seed: int) -> dict[str, list[tuple]]:
    rnd = random.Random(seed)
    pick = rnd.choice

    def maybe(value, chance=0.15):
        return None if rnd.random() < chance else value

    def money():
        return maybe(Decimal(rnd.randint(0, 99999)) / 100)

    def day():
        return AS_OF + timedelta(days=rnd.randint(-3, 3))

    def many(n, make):
        return [make() for _ in range(n)]

    def sale():
        article = pick(ARTICLES) if rnd.random() < 0.7 else 3
        period = pick([MONTH, START, START, 199803, END, 199712])
        return (pick(OUTLETS), article, period, rnd.randint(-3, 30))

    ean = [(1000 + rnd.randint(0, 30), a) for a in ARTICLES]
    return {
        "sales": many(400, sale),
        "collection": many(400, sale),
        "article": [
            (a, maybe(pick(LABS)), maybe(pick("PGARB")), maybe(date(1998, 1, 1), 0.6)) for a in ARTICLES if a != 20
        ],
        "offer": many(
            60,
            lambda: (
                pick(ARTICLES), f"l{rnd.randint(0, 9)}", maybe(pick([*LABS, "Brand#1", "Brand#9"])),
                Decimal(rnd.randint(0, 3)) / 10, day(), maybe(pick("PPG")), money(),
            ),
        ),
        "link_group": [
            (f"l{i % 10}", pick(GROUPS), f"{pick(WORDS)} {pick(['red', 'blue'])}  ", pick(["1", "2 "]), "", maybe("mg"), money())
            for i in range(13)
        ],
        "article_group": [(a, pick(GROUPS)) for a in ARTICLES] + [(3, pick(GROUPS))],
        "dci": [(g, pick(WORDS), maybe(pick(["red", "5"])), maybe(" x ")) for g in GROUPS for _ in range(rnd.randint(1, 2))],
        "lab": [(lab, maybe(name)) for lab, name in zip(LABS, ["One", "Two", "Two", "Four"])],
        "ean": ean,
        "excluded_ean": [(e,) for e, _ in rnd.sample(ean, 3)],
        "launch_ean": [(e,) for e, _ in rnd.sample(ean, 12)],
        "regulated_price": many(30, lambda: (pick(ARTICLES), money(), pick([0, 1, 1]))),
        "outlet": [(o, f"name {o}", "1", "t") for o in range(1, 11)],
        "crm": [(o, f"P{o}") for o in OUTLETS if o != 4] + [(5, "P5b")],
        "outlet_master": [(o, f"F{o}") for o in OUTLETS if o != 6],
        "member": [(f"F{o}", f"m{o}") for o in OUTLETS if o != 7],
        "completeness": [(o, MONTH, pick([1, 1, 1, 0])) for o in OUTLETS] + [(8, MONTH, 1)],
        "outlet_group": [(o, pick([1, 1, 2])) for o in OUTLETS],
    }


def arrow_table(name: str, data: list[tuple]) -> pa.Table:
    """The table as SQL sees it: strings right-trimmed, as the loader does."""

    def kind(field):
        text = field.dataType.simpleString()
        if text.startswith("decimal"):
            return pa.decimal128(field.dataType.precision, field.dataType.scale)
        return ARROW[text]

    def clean(value):
        return value.rstrip(" ") if isinstance(value, str) else value

    columns = list(zip(*data))
    fields = SCHEMAS[name].fields
    assert len(columns) == len(fields)
    arrays = [pa.array([clean(v) for v in column], kind(field)) for column, field in zip(columns, fields)]
    return pa.table(arrays, names=[field.name for field in fields])


CASES = {
    "focus_links": (
        lambda d: offers.focus_links(d, LAB, AS_OF),
        "SELECT link_id, CAST(best_rebate AS DOUBLE) FROM focus_links",
        [],
    ),
    "top_switch": (
        lambda d: offers.top_switch(d, LAB, AS_OF, START, END, k=3).select(
            "outlet_id", "link_id", "label", "lab_name", "rebate", "qty", "value", "rank"
        ),
        """SELECT outlet_id, link_id, label, lab_name, CAST(rebate AS DOUBLE), qty, CAST(value AS DOUBLE), rank
        FROM top_switch""",
        [oracle.switch_rows(START, END), oracle.top_switch_cte(3)],
    ),
    "top_originator": (
        lambda d: offers.top_originator(d, LAB, AS_OF, START, END, k=2).select(
            "outlet_id", "link_id", "label", "lab_name", "qty", "value", "rank"
        ),
        "SELECT outlet_id, link_id, label, lab_name, qty, CAST(value AS DOUBLE), rank FROM top_originator",
        [oracle.originator_rows(START, END), oracle.top_originator_cte(2)],
    ),
    "switch_total": (
        lambda d: offers.switch_total(d, LAB, AS_OF, START, END),
        "SELECT outlet_id, CAST(value AS DOUBLE) FROM switch_sum",
        oracle.totals(START, END),
    ),
    "margin_total": (
        lambda d: offers.margin_total(d, LAB, AS_OF, START, END),
        oracle.MARGIN,
        oracle.totals(START, END),
    ),
    "launch_scorecard": (
        lambda d: launches.launch_scorecard(d, LAB, START, END, k=3).select(
            "outlet_id", "rank", "dci", "share", "focus_qty", "competitor_qty", "originator_qty"
        ),
        "SELECT outlet_id, rank, dci, share, focus_qty, competitor_qty, originator_qty FROM launches",
        [oracle.launch_cte(START, END, 3)],
    ),
    "molecule_range": (
        lambda d: molecules.molecule_scorecard(d, LAB, START, END, star.RULES, star.PREFIXES),
        f"SELECT {oracle.MOLECULE_COLUMNS} FROM card",
        [oracle.molecule_cte("card", START, END)],
    ),
    "eligible_outlets": (
        lambda d: outlets.eligible_outlets(d, LAB, MONTH, 1, 0.05, min_outlet_id=2),
        "SELECT * FROM eligible",
        [oracle.eligible_cte(0.05)],
    ),
}


@pytest.mark.parametrize("way", ["broadcast", "shuffle"])
@pytest.mark.parametrize("seed", range(3))
def test_random_domain(spark, make_domain, seed, way):
    tables = random_tables(seed)
    domain = make_domain(**tables)
    connection = duckdb.connect()
    for name, data in tables.items():
        connection.register(name, arrow_table(name, data))
    if way == "shuffle":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for case, (operator, body, ctes) in CASES.items():
            sql = "WITH " + ",\n".join([oracle.DERIVED, *ctes]) + "\n" + body
            expected = sorted(connection.execute(sql).fetchall(), key=repr)
            assert rows(plain(operator(domain))) == expected, case
            assert expected, f"{case} shows nothing"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

