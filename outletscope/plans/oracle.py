"""The registered queries as DuckDB SQL, written row by row from their meaning to check the Spark jobs."""

from __future__ import annotations

from outletscope.constants import (
    HOLIDAYS_2025,
    MONTH_NAMES,
    NO_DATA_TEXT,
    NO_ERROR_TEXT,
)
from outletscope.plans.queries import END, MONTH, REPORT_MIN_SHARE, SINCE, START
from outletscope.sources.schemas import SCHEMAS, key_columns
from outletscope.sources.star import PREFIXES, RULES

FOCUS = "'Brand#1'"
AS_OF = "DATE '1998-06-30'"
LINK = "p_name || '#' || CAST(p_size % 4 AS VARCHAR)"
KIND = "CASE p_partkey % 5 WHEN 0 THEN 'P' WHEN 1 THEN 'G' WHEN 2 THEN 'A' WHEN 3 THEN 'R' ELSE 'B' END"
PRICE = "CAST(p_retailprice AS DECIMAL(12,2))"
PADDED = "lpad(CAST({0} AS VARCHAR), CAST(greatest(5, length(CAST({0} AS VARCHAR))) AS INTEGER), '0')"


def domain(outlet_by: str = "nation") -> str:
    """The domain tables as common table expressions."""
    if outlet_by == "customer":
        outlet_id = "o.o_custkey"
        outlet = f"""SELECT c_custkey AS outlet_id, c_name AS name, {PADDED.format('c_custkey')} AS postcode,
            n_name AS town FROM customer JOIN nation ON c_nationkey = n_nationkey"""
    else:
        outlet_id = "c.c_nationkey"
        outlet = f"""SELECT CAST(n_nationkey AS BIGINT) AS outlet_id, n_name AS name, {PADDED.format('n_nationkey')} AS postcode,
            r_name AS town FROM nation JOIN region ON n_regionkey = r_regionkey"""
    customers = "" if outlet_by == "customer" else "JOIN customer c ON c.c_custkey = o.o_custkey"
    return f"""WITH
order_outlet AS (
    SELECT o.o_orderkey, CAST({outlet_id} AS BIGINT) AS outlet_id,
        CAST(year(o.o_orderdate) * 100 + month(o.o_orderdate) AS INTEGER) AS period
    FROM orders o {customers}),
sales AS (
    SELECT outlet_id, l_partkey AS article_id, period, CAST(l_quantity AS BIGINT) AS qty
    FROM lineitem JOIN order_outlet ON l_orderkey = o_orderkey),
article AS (
    SELECT p_partkey AS article_id, p_brand AS maker_lab, {KIND} AS type,
        CASE WHEN p_partkey % 3 = 0 THEN DATE '1998-01-01' END AS stopped_on FROM part),
offer AS (
    SELECT p_partkey AS article_id, p_brand AS lab, {LINK} AS link_id,
        CAST(p_size / 100.0 AS DECIMAL(5,2)) AS rebate,
        DATE '1998-01-01' + CAST((p_partkey * 37) % 365 AS INTEGER) AS valid_until,
        {KIND} AS type, {PRICE} AS price FROM part),
link_group AS (
    SELECT {LINK} AS link_id, {LINK} AS group_id,
        split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS short_label,
        CAST(p_size % 4 AS VARCHAR) AS pack, '' AS volume, CAST(NULL AS VARCHAR) AS unit,
        max({PRICE}) AS group_price
    FROM part GROUP BY ALL),
article_group AS (SELECT p_partkey AS article_id, {LINK} AS group_id FROM part),
dci AS (
    SELECT DISTINCT {LINK} AS group_id, split_part(p_name, ' ', 2) AS dci, split_part(p_name, ' ', 1) AS dose,
        CAST(NULL AS VARCHAR) AS form FROM part),
lab AS (SELECT DISTINCT p_brand AS lab, p_brand AS lab_name FROM part),
ean AS (SELECT p_partkey + 3400000000000 AS ean, p_partkey AS article_id FROM part),
excluded_ean AS (SELECT p_partkey + 3400000000000 AS ean FROM part WHERE p_partkey % 17 = 0),
launch_ean AS (SELECT p_partkey + 3400000000000 AS ean FROM part WHERE p_partkey % 10 < 3),
regulated_price AS (
    SELECT p_partkey AS article_id, {PRICE} AS price, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS active
    FROM part WHERE p_partkey % 7 <> 0),
outlet AS ({outlet}),
crm AS (SELECT outlet_id, 'P' || postcode AS code FROM outlet),
outlet_master AS (SELECT outlet_id, 'F' || postcode AS finess FROM outlet),
member AS (
    SELECT 'F' || postcode AS finess, 'outlet' || CAST(outlet_id AS VARCHAR) || '@example.org' AS mail
    FROM outlet WHERE outlet_id % 6 <> 0),
completeness AS (
    SELECT outlet_id, period, CASE WHEN count(*) >= 8 THEN 1 ELSE 0 END AS ok
    FROM order_outlet GROUP BY outlet_id, period),
outlet_group AS (SELECT outlet_id, CASE WHEN outlet_id % 4 = 1 THEN 2 ELSE 1 END AS group_no FROM outlet),
collection AS (SELECT * FROM sales)"""


DERIVED = f"""focus_links AS (
    SELECT link_id, max(rebate) AS best_rebate FROM offer
    WHERE lab = {FOCUS} AND valid_until > {AS_OF}
        AND article_id NOT IN (SELECT article_id FROM ean WHERE ean IN (SELECT ean FROM excluded_ean))
    GROUP BY link_id),
labelled AS (
    SELECT *, rtrim(coalesce(rtrim(short_label), '') || ' ' || coalesce(rtrim(pack), '') || ' '
        || coalesce(rtrim(volume), '') || ' ' || coalesce(rtrim(unit), '')) AS label
    FROM link_group)"""


def switch_rows(start: int, end: int) -> str:
    return f"""switch_rows AS (
    SELECT s.outlet_id, f.link_id, g.label, l.lab_name, o.rebate, s.qty, s.qty * o.price AS value
    FROM focus_links f
    JOIN offer o ON o.link_id = f.link_id
    JOIN sales s ON s.article_id = o.article_id
    JOIN labelled g ON g.link_id = o.link_id
    LEFT JOIN lab l ON l.lab = o.lab
    WHERE s.period BETWEEN {start} AND {end} AND o.lab <> {FOCUS}
        AND g.group_id IN (
            SELECT ag.group_id FROM article_group ag JOIN article a ON a.article_id = ag.article_id
            WHERE a.type = 'G' AND a.stopped_on IS NULL))"""


def originator_rows(start: int, end: int) -> str:
    return f"""originator_rows AS (
    SELECT s.outlet_id, f.link_id, g.label, l.lab_name, s.qty, s.qty * g.group_price AS value
    FROM focus_links f
    JOIN offer o ON o.link_id = f.link_id
    JOIN sales s ON s.article_id = o.article_id
    JOIN labelled g ON g.link_id = o.link_id
    JOIN article a ON a.article_id = s.article_id
    JOIN lab l ON l.lab = a.maker_lab
    WHERE s.period BETWEEN {start} AND {end} AND o.type = 'P')"""


def top_switch_cte(k: int = 10) -> str:
    return f"""top_switch AS (
    SELECT * FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY outlet_id
            ORDER BY value DESC NULLS LAST, label, lab_name NULLS LAST, rebate NULLS LAST, link_id) AS INTEGER) AS rank
        FROM (
            SELECT outlet_id, link_id, label, lab_name, rebate, CAST(sum(qty) AS BIGINT) AS qty, sum(value) AS value
            FROM switch_rows GROUP BY outlet_id, link_id, label, lab_name, rebate))
    WHERE rank <= {k})"""


def top_originator_cte(k: int = 5) -> str:
    return f"""top_originator AS (
    SELECT * FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY outlet_id
            ORDER BY value DESC NULLS LAST, label, lab_name NULLS LAST, link_id) AS INTEGER) AS rank
        FROM (
            SELECT outlet_id, link_id, label, lab_name, CAST(sum(qty) AS BIGINT) AS qty, sum(value) AS value
            FROM originator_rows GROUP BY outlet_id, link_id, label, lab_name))
    WHERE rank <= {k})"""


def launch_cte(start: int, end: int, k: int = 10) -> str:
    return f"""launch_article AS (SELECT article_id FROM ean WHERE ean IN (SELECT ean FROM launch_ean)),
spine AS (
    SELECT DISTINCT dci FROM dci WHERE group_id IN (
        SELECT group_id FROM article_group WHERE article_id IN (SELECT article_id FROM launch_article))),
launch_sales AS (
    SELECT s.outlet_id, d.dci,
        sum(CASE WHEN a.maker_lab = {FOCUS} THEN qty ELSE 0 END) AS focus,
        sum(CASE WHEN a.maker_lab <> {FOCUS} AND a.type IN ('G', 'A') THEN qty ELSE 0 END) AS competitor,
        sum(CASE WHEN a.type IN ('G', 'A') THEN qty ELSE 0 END) AS total,
        sum(CASE WHEN a.type = 'P' THEN qty ELSE 0 END) AS originator
    FROM sales s
    JOIN article_group ag ON ag.article_id = s.article_id
    JOIN dci d ON d.group_id = ag.group_id
    JOIN article a ON a.article_id = s.article_id
    WHERE s.period BETWEEN {start} AND {end} AND s.article_id IN (SELECT article_id FROM launch_article)
    GROUP BY s.outlet_id, d.dci),
launch_grid AS (
    SELECT o.outlet_id, p.dci,
        coalesce((CAST(t.focus AS BIGINT) * 10000 // nullif(CAST(t.total AS BIGINT), 0)) / 100.0, 0) AS share,
        CAST(coalesce(t.focus, 0) AS BIGINT) AS focus_qty,
        CAST(coalesce(t.competitor, 0) AS BIGINT) AS competitor_qty,
        CAST(coalesce(t.originator, 0) AS BIGINT) AS originator_qty
    FROM outlet o CROSS JOIN spine p
    LEFT JOIN launch_sales t ON t.outlet_id = o.outlet_id AND t.dci = p.dci),
launches AS (
    SELECT * FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY outlet_id ORDER BY share DESC, dci) AS INTEGER) AS rank
        FROM launch_grid)
    WHERE rank <= {k})"""


NAME = "coalesce(rtrim(dci), '') || ' ' || coalesce(rtrim(dose), '') || ' ' || coalesce(rtrim(form), '')"


def _rule(rule) -> str:
    found = f"upper({NAME}) LIKE '%{rule.include.upper()}%'"
    return found + (f" AND upper({NAME}) NOT LIKE '%{rule.exclude.upper()}%'" if rule.exclude else "")


MOLECULE = "CASE " + " ".join(f"WHEN {_rule(r)} THEN {r.sort_order}" for r in RULES) + " END"


def molecule_cte(name: str, start: int, end: int) -> str:
    prefixes = " OR ".join(f"short_label ILIKE '{p}%'" for p in PREFIXES)
    rules = " UNION ALL ".join(f"SELECT {r.sort_order} AS sort_order, '{r.display}' AS molecule" for r in RULES)
    share = """CAST(CASE WHEN {0} + {1} = 0 THEN 0
            ELSE round(CAST(CAST({0} AS DOUBLE) * 100 / CAST({0} + {1} AS DOUBLE) AS DECIMAL(18,7)), 2) END AS DOUBLE)"""
    return f"""{name}_sold AS (
    SELECT s.outlet_id, m.sort_order,
        sum(CASE WHEN a.maker_lab = {FOCUS} THEN s.qty ELSE 0 END) AS focus_qty,
        sum(CASE WHEN a.maker_lab <> {FOCUS} THEN s.qty ELSE 0 END) AS other_qty,
        sum(CASE WHEN a.maker_lab = {FOCUS} THEN s.qty * p.price ELSE 0 END) AS focus_value,
        sum(CASE WHEN a.maker_lab <> {FOCUS} THEN s.qty * p.price ELSE 0 END) AS other_value
    FROM collection s
    JOIN article_group ag ON ag.article_id = s.article_id
    JOIN (SELECT group_id, {MOLECULE} AS sort_order FROM dci) m ON m.group_id = ag.group_id
    JOIN article a ON a.article_id = s.article_id
    JOIN lab l ON l.lab = a.maker_lab
    LEFT JOIN regulated_price p ON p.article_id = s.article_id AND p.active = 1
    WHERE s.period BETWEEN {start} AND {end} AND a.type IN ('R', 'B') AND m.sort_order IS NOT NULL
        AND ag.group_id IN (SELECT group_id FROM link_group WHERE {prefixes})
    GROUP BY s.outlet_id, m.sort_order),
{name}_grid AS (
    SELECT o.outlet_id, r.molecule, r.sort_order, coalesce(t.focus_qty, 0) AS focus_qty,
        coalesce(t.other_qty, 0) AS other_qty, coalesce(t.focus_value, 0) AS focus_value,
        coalesce(t.other_value, 0) AS other_value
    FROM outlet o CROSS JOIN ({rules}) r
    LEFT JOIN {name}_sold t ON t.outlet_id = o.outlet_id AND t.sort_order = r.sort_order),
{name} AS (
    SELECT outlet_id, molecule, CAST(focus_qty AS BIGINT) AS focus_qty, CAST(other_qty AS BIGINT) AS other_qty,
        focus_value, other_value, {share.format('focus_value', 'other_value')} AS share,
        false AS is_total, sort_order
    FROM {name}_grid
    UNION ALL
    SELECT outlet_id, 'TOTAL', CAST(sum(focus_qty) AS BIGINT), CAST(sum(other_qty) AS BIGINT),
        sum(focus_value), sum(other_value), {share.format('sum(focus_value)', 'sum(other_value)')}, true, 999
    FROM {name}_grid GROUP BY outlet_id)"""


MOLECULE_COLUMNS = """outlet_id, molecule, focus_qty, other_qty, CAST(focus_value AS DOUBLE) AS focus_value,
    CAST(other_value AS DOUBLE) AS other_value, share, is_total, sort_order"""


def gap_columns(card: str, suffix: str = "") -> str:
    gaps = ", ".join(
        f"CAST(CASE WHEN share < {t} THEN (focus_value + other_value) * {t / 100:.1f} - focus_value ELSE 0 END "
        f"AS DOUBLE) AS gap_{t}{suffix}"
        for t in (30, 50)
    )
    return f"SELECT outlet_id, share AS total_share{suffix}, {gaps} FROM {card} WHERE is_total"


def eligible_cte(min_share: float) -> str:
    return f"""focus_value AS (
    SELECT s.outlet_id, sum(s.qty * o.price) AS focus FROM sales s JOIN offer o ON o.article_id = s.article_id
    WHERE o.lab = {FOCUS} AND s.period = {MONTH} AND s.outlet_id IN (
        SELECT outlet_id FROM completeness WHERE period = {MONTH} AND ok = 1
        GROUP BY outlet_id HAVING sum(ok) = 1)
    GROUP BY s.outlet_id),
potential AS (
    SELECT s.outlet_id, sum(s.qty * o.price) AS potential FROM sales s JOIN offer o ON o.article_id = s.article_id
    WHERE s.period = {MONTH} AND s.outlet_id > 2 GROUP BY s.outlet_id),
eligible AS (
    SELECT f.outlet_id, c.code, b.mail, CAST(f.focus AS DOUBLE) AS focus_value,
        CAST(p.potential AS DOUBLE) AS potential,
        CAST(f.focus * 100 AS DOUBLE) / CAST(p.potential * 100 AS DOUBLE) AS share
    FROM focus_value f
    JOIN potential p ON p.outlet_id = f.outlet_id AND p.potential <> 0
    LEFT JOIN crm c ON c.outlet_id = f.outlet_id
    LEFT JOIN outlet_master m ON m.outlet_id = c.outlet_id
    LEFT JOIN member b ON b.finess = m.finess
    WHERE CAST(f.focus * 100 AS DOUBLE) / CAST(p.potential * 100 AS DOUBLE) >= {min_share}
        AND f.outlet_id IN (SELECT outlet_id FROM outlet_group WHERE group_no = 1))"""


LABEL = """CASE WHEN regexp_matches(trim(name, ' \t\r\n'), '(?i)pharmacie\\b') THEN trim(name, ' \t\r\n')
        ELSE 'Pharmacie ' || trim(name, ' \t\r\n') END
        || ' - ' || trim(postcode, ' \t\r\n') || '  ' || trim(town, ' \t\r\n')"""


def query(body: str, *ctes: str, outlet_by: str = "nation") -> str:
    return ",\n".join([domain(outlet_by), DERIVED, *ctes]) + "\n" + body


# --- calendar -------------------------------------------------------------------

DAYS = "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY 1"
MONTHS = """SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS period, count(*) AS orders
    FROM orders GROUP BY 1"""
LAST_MONTH = "CAST(day - INTERVAL 1 MONTH AS DATE)"
OVERFLOWN = "(date_trunc('month', day) - INTERVAL 1 MONTH + to_days(CAST(day(day) - 1 AS INTEGER)))"
CLOSED = "(isodow({0}) >= 6 OR strftime({0}, '%m-%d') IN (" + ", ".join(
    f"'{d:%m-%d}'" for d in HOLIDAYS_2025
) + "))"


def key_of(day: str) -> str:
    return f"CAST(year({day}) * 100 + month({day}) AS INTEGER)"


def roll_forward(day: str) -> str:
    """First open day among the ten that start at ``day``."""
    step = f"({day} + CAST(i AS INTEGER))"
    return f"(SELECT CAST(min({step}) AS VARCHAR) FROM range(10) t(i) WHERE NOT {CLOSED.format(step)})"


def planned(n: int) -> str:
    return f"make_date(period // 100, period % 100, {n})"


MONTH_NAME = "CASE {0} % 100 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MONTH_NAMES, 1)) + " END"
MONTH_LABEL = MONTH_NAME + " || ' ' || CAST({0} // 100 AS VARCHAR)"


# --- display --------------------------------------------------------------------


def capital(text: str, width: int) -> str:
    cut = f"lower(CASE WHEN length({text}) > {width} THEN substr({text}, 1, {width}) || ' ' ELSE {text} END)"
    return f"upper(substr({cut}, 1, 1)) || substr({cut}, 2)"


def money(value: str) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(38,4)), 2)::DECIMAL(38,2) AS VARCHAR) || '€'"


def percent(value: str) -> str:
    return f"regexp_replace(CAST(CAST({value} AS DECIMAL(20,2)) AS VARCHAR), '\\.?0+$', '') || ' %'"


BAND = "CASE WHEN share < 50 THEN 'pdm-low' WHEN share > 80 THEN 'pdm-high' ELSE '' END"


def shown(table: str, columns: str) -> str:
    return f"""SELECT o.outlet_id, {columns}, t.outlet_id IS NOT NULL AS has_data,
        CASE WHEN t.outlet_id IS NULL THEN '{NO_DATA_TEXT}' END AS message
    FROM outlet o LEFT JOIN {table} t ON t.outlet_id = o.outlet_id"""


# --- report ---------------------------------------------------------------------

FIRST = 199801
REPORT_CTES = (
    eligible_cte(REPORT_MIN_SHARE),
    switch_rows(MONTH, MONTH),
    originator_rows(MONTH, MONTH),
    top_switch_cte(),
    top_originator_cte(),
    launch_cte(FIRST, MONTH),
    molecule_cte("card", MONTH, MONTH),
    molecule_cte("card_since", SINCE, MONTH),
)


def totals(start: int, end: int) -> tuple[str, str, str]:
    return (
        switch_rows(start, end),
        originator_rows(start, end),
        """switch_sum AS (
    SELECT o.outlet_id, coalesce(sum(value), 0) AS value FROM outlet o
    LEFT JOIN switch_rows s ON s.outlet_id = o.outlet_id GROUP BY o.outlet_id),
originator_sum AS (
    SELECT o.outlet_id, coalesce(sum(value), 0) AS value FROM outlet o
    LEFT JOIN originator_rows s ON s.outlet_id = o.outlet_id GROUP BY o.outlet_id)""",
    )


MARGIN = """SELECT s.outlet_id, CAST(s.value AS DOUBLE) AS switch_total, CAST(p.value AS DOUBLE) AS originator_total,
    CAST(s.value + p.value AS DOUBLE) AS margin
    FROM switch_sum s JOIN originator_sum p ON p.outlet_id = s.outlet_id"""

STATUS = f"""status AS (
    SELECT e.outlet_id, {MONTH} AS period, e.mail,
        CASE WHEN e.mail IS NULL THEN 'ERREUR: no mail address' ELSE 'OK' END AS status
    FROM eligible e)"""

AREA = """area AS (
    SELECT n_nationkey AS area_id, 100 * (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS population,
        (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS outlets
    FROM nation),
quota AS (
    SELECT *, CAST(CASE WHEN population < 2500 THEN 0 ELSE 1 + floor((population - 2500) / 4500) END AS BIGINT) AS allowed
    FROM area),
gap AS (
    SELECT *, outlets - allowed AS surplus, CAST(population AS DOUBLE) / nullif(outlets, 0) AS inhabitants_per_outlet
    FROM quota)"""


def key_checks() -> str:
    parts = [
        f"SELECT '{name}' AS table_name, count(*) AS rows, '{key}' AS key_column, "
        f"count(*) FILTER (WHERE {key} IS NULL) AS nulls FROM {name}"
        for name in SCHEMAS
        for key in key_columns(name)
    ]
    return query(" UNION ALL ".join(parts))


def top_switch(outlet_by: str) -> str:
    body = """SELECT outlet_id, link_id, label, lab_name, CAST(rebate AS DOUBLE) AS rebate, qty,
        CAST(value AS DOUBLE) AS value, rank FROM top_switch"""
    return query(body, switch_rows(START, END), top_switch_cte(), outlet_by=outlet_by)


def top_originator(outlet_by: str) -> str:
    body = """SELECT outlet_id, link_id, label, lab_name, qty, CAST(value AS DOUBLE) AS value, rank
        FROM top_originator"""
    return query(body, originator_rows(START, END), top_originator_cte(), outlet_by=outlet_by)


def launch_scorecard(outlet_by: str) -> str:
    body = """SELECT outlet_id, rank, dci, share, focus_qty, competitor_qty, originator_qty FROM launches"""
    return query(body, launch_cte(FIRST, MONTH), outlet_by=outlet_by)


def molecules(start: int, end: int, outlet_by: str = "nation") -> str:
    return query(f"SELECT {MOLECULE_COLUMNS} FROM card", molecule_cte("card", start, end), outlet_by=outlet_by)


def section(name: str, position: str, label: str, qty: str, amount: str, table: str, more: tuple[str, ...]) -> str:
    texts = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in more)
    return f"""SELECT t.outlet_id, {MONTH} AS period, '{name}' AS section, {position} AS position, {label} AS name,
        {qty} AS qty, CAST({amount} AS DOUBLE) AS amount, {texts} AS more
        FROM {table} t JOIN eligible e ON e.outlet_id = t.outlet_id"""


CARD_MORE = ("other_qty", "CAST(t.focus_value AS DECIMAL(20,2))", "CAST(t.other_value AS DECIMAL(20,2))")


REPORT_FLAT = " UNION ALL ".join(
    [
        section("top_switch", "rank", "label", "qty", "value", "top_switch", ("lab_name", "rebate")),
        section("top_originator", "rank", "label", "qty", "value", "top_originator", ("lab_name",)),
        section("launches", "rank", "dci", "focus_qty", "t.share", "launches", ("competitor_qty", "originator_qty")),
        section("molecules", "sort_order", "molecule", "focus_qty", "t.share", "card", CARD_MORE),
        section("molecules_since", "sort_order", "molecule", "focus_qty", "t.share", "card_since", CARD_MORE),
    ]
)

REPORT_TOTALS = f"""SELECT e.outlet_id, e.code, e.mail, {MONTH} AS period,
    '{MONTH_NAMES[MONTH % 100 - 1]} {MONTH // 100}' AS month,
    {LABEL} AS label, m.switch_total, m.originator_total, m.margin,
    g.total_share, g.gap_30, g.gap_50, h.total_share_since, h.gap_30_since, h.gap_50_since
    FROM eligible e
    JOIN outlet o ON o.outlet_id = e.outlet_id
    JOIN ({MARGIN}) m ON m.outlet_id = e.outlet_id
    JOIN ({gap_columns('card')}) g ON g.outlet_id = e.outlet_id
    JOIN ({gap_columns('card_since', '_since')}) h ON h.outlet_id = e.outlet_id"""

# --- windows that end in each month -----------------------------------------------

HOLIDAY = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE strftime(o_orderdate, '%m-%d') IN (" + ", ".join(
    f"'{d:%m-%d}'" for d in HOLIDAYS_2025
) + ")"


def next_open(day: str) -> str:
    """First day, of the sixty that start at ``day``, that is neither a weekend day nor in the holiday table."""
    step = f"({day} + CAST(i AS INTEGER))"
    return f"(SELECT CAST(min({step}) AS VARCHAR) FROM range(60) t(i) WHERE isodow({step}) < 6 AND {step} NOT IN (SELECT day FROM holiday))"


SIX_MONTHS = "CASE WHEN w.period % 100 > 5 THEN w.period - 5 ELSE w.period - 100 + 7 END"


def windows_cte(first: int) -> str:
    return f"""ends AS (SELECT DISTINCT period FROM sales WHERE period BETWEEN {first} AND {END})"""


LAUNCH_WINDOWS = f"""SELECT outlet_id, period, dci,
        CAST(coalesce((focus * 10000 // nullif(total, 0)) / 100.0, 0) AS DOUBLE) AS share,
        focus AS focus_qty, competitor AS competitor_qty, originator AS originator_qty
    FROM (
        SELECT s.outlet_id, w.period, d.dci,
            CAST(sum(CASE WHEN a.maker_lab = {FOCUS} THEN qty ELSE 0 END) AS BIGINT) AS focus,
            CAST(sum(CASE WHEN a.maker_lab <> {FOCUS} AND a.type IN ('G', 'A') THEN qty ELSE 0 END) AS BIGINT) AS competitor,
            CAST(sum(CASE WHEN a.type IN ('G', 'A') THEN qty ELSE 0 END) AS BIGINT) AS total,
            CAST(sum(CASE WHEN a.type = 'P' THEN qty ELSE 0 END) AS BIGINT) AS originator
        FROM ends w
        JOIN sales s ON s.period BETWEEN {SIX_MONTHS} AND w.period
        JOIN article_group ag ON ag.article_id = s.article_id
        JOIN dci d ON d.group_id = ag.group_id
        JOIN article a ON a.article_id = s.article_id
        WHERE s.article_id IN (SELECT article_id FROM ean WHERE ean IN (SELECT ean FROM launch_ean))
        GROUP BY s.outlet_id, w.period, d.dci)"""


def molecule_windows(start: str) -> str:
    prefixes = " OR ".join(f"short_label ILIKE '{p}%'" for p in PREFIXES)
    names = "CASE sort_order " + " ".join(f"WHEN {r.sort_order} THEN '{r.display}'" for r in RULES) + " ELSE 'TOTAL' END"
    return f"""SELECT outlet_id, period, {names} AS molecule, CAST(focus_qty AS BIGINT) AS focus_qty,
        CAST(other_qty AS BIGINT) AS other_qty, CAST(focus_value AS DOUBLE) AS focus_value, CAST(other_value AS DOUBLE) AS other_value,
        CAST(CASE WHEN focus_value + other_value = 0 THEN 0 ELSE round(CAST(CAST(focus_value AS DOUBLE) * 100
            / CAST(focus_value + other_value AS DOUBLE) AS DECIMAL(18,7)), 2) END AS DOUBLE) AS share,
        CAST(sort_order AS INTEGER) AS sort_order
    FROM (
        SELECT s.outlet_id, w.period, coalesce(m.sort_order, 999) AS sort_order,
            sum(CASE WHEN a.maker_lab = {FOCUS} THEN s.qty ELSE 0 END) AS focus_qty,
            sum(CASE WHEN a.maker_lab <> {FOCUS} THEN s.qty ELSE 0 END) AS other_qty,
            sum(CASE WHEN a.maker_lab = {FOCUS} THEN s.qty * coalesce(p.price, 0) ELSE 0 END) AS focus_value,
            sum(CASE WHEN a.maker_lab <> {FOCUS} THEN s.qty * coalesce(p.price, 0) ELSE 0 END) AS other_value
        FROM ends w
        JOIN collection s ON s.period BETWEEN {start} AND w.period
        JOIN article_group ag ON ag.article_id = s.article_id
        JOIN (SELECT group_id, {MOLECULE} AS sort_order FROM dci) m ON m.group_id = ag.group_id
        JOIN article a ON a.article_id = s.article_id
        JOIN lab l ON l.lab = a.maker_lab
        LEFT JOIN regulated_price p ON p.article_id = s.article_id AND p.active = 1
        WHERE a.type IN ('R', 'B') AND m.sort_order IS NOT NULL
            AND ag.group_id IN (SELECT group_id FROM link_group WHERE {prefixes})
        GROUP BY GROUPING SETS ((s.outlet_id, w.period, m.sort_order), (s.outlet_id, w.period)))"""


ORACLE: dict[str, str] = {
    "month_keys": f"""SELECT CAST(day AS VARCHAR) AS day, orders, {key_of(LAST_MONTH)} AS previous,
        {key_of(OVERFLOWN)} AS previous_overflow, {MONTH_LABEL.format(f'({key_of(LAST_MONTH)})')} AS label
        FROM ({DAYS})""",
    "period_windows": f"""SELECT period, orders,
        CASE WHEN period % 100 > 5 THEN period - 5 ELSE period - 100 + 7 END AS trailing_start,
        CASE WHEN period >= {SINCE} THEN {SINCE} END AS since_start, period >= {SINCE} AS since_valid
        FROM ({MONTHS})""",
    "send_dates": f"""SELECT period, orders, {roll_forward(planned(17))} AS send_date_17,
        {roll_forward(planned(10))} AS send_date_10 FROM ({MONTHS})""",
    "business_days": f"""SELECT CAST(day AS VARCHAR) AS day, orders, {roll_forward('day')} AS business_day
        FROM ({DAYS})""",
    "business_calendar": f"""WITH holiday AS ({HOLIDAY}), bounds AS (
        SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS z FROM orders),
    days AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM bounds)
    SELECT CAST(day AS VARCHAR) AS day, isodow(day) < 6 AND day NOT IN (SELECT day FROM holiday) AS is_open,
        {next_open('day')} AS business_day FROM days""",
    "calendar_send_dates": f"""WITH holiday AS ({HOLIDAY}), days AS (
        SELECT period, orders, {planned(17)} AS day FROM ({MONTHS}))
    SELECT period, orders, CAST(day AS VARCHAR) AS day, {next_open('day')} AS send_date FROM days""",
    "launch_windows": query(LAUNCH_WINDOWS, windows_cte(START)),
    "molecule_windows": query(molecule_windows(SIX_MONTHS), windows_cte(SINCE)),
    "molecule_since_windows": query(molecule_windows(str(SINCE)), windows_cte(SINCE)),
    "key_checks": key_checks(),
    "loaded_key_checks": key_checks(),
    "monthly_sales": query(
        "SELECT outlet_id, article_id, period, CAST(sum(qty) AS BIGINT) AS qty FROM sales GROUP BY 1, 2, 3"
    ),
    "outlet_labels": query(f"SELECT outlet_id, {LABEL} AS label FROM outlet"),
    "outlet_labels_customers": query(f"SELECT outlet_id, {LABEL} AS label FROM outlet", outlet_by="customer"),
    "wanted_labels": query(
        f"""SELECT w.outlet_id, l.label FROM (SELECT DISTINCT o_custkey % 40 AS outlet_id FROM orders) w
        LEFT JOIN (SELECT outlet_id, {LABEL} AS label FROM outlet) l ON l.outlet_id = w.outlet_id"""
    ),
    "long_labels": query(
        f"""SELECT p_partkey AS article_id, {capital('t', 80)} AS cut_80, {capital('t', 25)} AS cut_25
        FROM (SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_name, p_brand, p_name, p_brand, p_name, p_brand, p_name, p_brand) AS t FROM part)"""
    ),
    "contact_list": query(
        """SELECT c.outlet_id, c.code, b.mail FROM crm c LEFT JOIN outlet_master m ON m.outlet_id = c.outlet_id
        LEFT JOIN member b ON b.finess = m.finess""",
        outlet_by="customer",
    ),
    "eligible_outlets": query("SELECT * FROM eligible", eligible_cte(0.05)),
    "wanted_outlets": query("SELECT * FROM eligible WHERE outlet_id % 2 = 0", eligible_cte(REPORT_MIN_SHARE)),
    "focus_potential": query(
        f"""SELECT s.outlet_id, CAST(sum(CASE WHEN o.lab = {FOCUS} THEN s.qty * o.price END) AS DOUBLE) AS focus_value,
        CAST(sum(s.qty * o.price) AS DOUBLE) AS value, bool_or(o.lab = {FOCUS}) AS sold_focus
        FROM sales s JOIN offer o ON o.article_id = s.article_id WHERE s.period = {MONTH} GROUP BY s.outlet_id""",
        outlet_by="customer",
    ),
    "having_exactly_one": query(
        "SELECT outlet_id, period FROM completeness WHERE ok = 1 GROUP BY outlet_id, period HAVING sum(ok) = 1"
    ),
    "focus_links": query("SELECT link_id, CAST(best_rebate AS DOUBLE) AS best_rebate FROM focus_links"),
    "not_in_exclusion": query(
        """SELECT lab, count(*) AS offers, CAST(sum(price) AS DOUBLE) AS price FROM offer
        WHERE article_id NOT IN (SELECT article_id FROM ean WHERE ean IN (SELECT ean FROM excluded_ean))
        GROUP BY lab"""
    ),
    "top_switch": top_switch("nation"),
    "top_switch_customers": top_switch("customer"),
    "top_originator": top_originator("nation"),
    "top_originator_customers": top_originator("customer"),
    "switch_total": query("SELECT outlet_id, CAST(value AS DOUBLE) AS value FROM switch_sum", *totals(START, END)),
    "originator_total": query(
        "SELECT outlet_id, CAST(value AS DOUBLE) AS value FROM originator_sum", *totals(START, END)
    ),
    "margin_total": query(MARGIN, *totals(START, END)),
    "margin_total_customers": query(MARGIN, *totals(START, END), outlet_by="customer"),
    "launch_scorecard": launch_scorecard("nation"),
    "launch_scorecard_customers": launch_scorecard("customer"),
    "molecule_class": query(f"SELECT group_id, {NAME} AS name, {MOLECULE} AS sort_order FROM dci"),
    "molecule_month": molecules(MONTH, MONTH),
    "molecule_range": molecules(START, END),
    "molecule_range_customers": molecules(START, END, "customer"),
    "share_gap": query(gap_columns("card"), molecule_cte("card", START, END)),
    "share_band": query(
        f"SELECT outlet_id, molecule, share, {BAND} AS band FROM card",
        molecule_cte("card", START, END),
        outlet_by="customer",
    ),
    "left_join_on_predicate": query(
        f"""SELECT s.outlet_id, CAST(sum(s.qty) AS BIGINT) AS qty,
        CAST(sum(CASE WHEN p.price IS NULL THEN s.qty END) AS BIGINT) AS unpriced_qty,
        CAST(sum(s.qty * p.price) AS DOUBLE) AS value
        FROM sales s JOIN article a ON a.article_id = s.article_id
        LEFT JOIN regulated_price p ON p.article_id = s.article_id AND p.active = 1
        WHERE s.period BETWEEN {START} AND {END} GROUP BY s.outlet_id"""
    ),
    "total_row": query(
        f"""SELECT outlet_id, maker_lab, CAST(grouping(outlet_id, maker_lab) AS INTEGER) AS level,
        CAST(sum(qty) AS BIGINT) AS qty
        FROM sales s JOIN article a ON a.article_id = s.article_id GROUP BY ROLLUP (outlet_id, maker_lab)"""
    ),
    "sql_with_parameters": query(
        f"""SELECT s.outlet_id, l.lab_name, CAST(sum(s.qty) AS BIGINT) AS qty,
        CAST(sum(s.qty * o.price) AS DOUBLE) AS value
        FROM sales s JOIN offer o ON o.article_id = s.article_id LEFT JOIN lab l ON l.lab = o.lab
        WHERE s.period BETWEEN {START} AND {END} AND o.lab <> {FOCUS} AND o.valid_until > {AS_OF}
        GROUP BY s.outlet_id, l.lab_name"""
    ),
    "display_switch": query(
        shown(
            "top_switch",
            f"rank, {capital('label', 80)} AS label_text, CAST(qty AS VARCHAR) AS qty_text, "
            f"{money('value')} AS value_text",
        ),
        switch_rows(MONTH, MONTH),
        top_switch_cte(),
        outlet_by="customer",
    ),
    "display_originator": query(
        shown(
            "top_originator",
            f"rank, {capital('label', 80)} AS label_text, {capital('lab_name', 25)} AS lab_text, "
            f"CAST(qty AS VARCHAR) AS qty_text, {money('value')} AS value_text",
        ),
        originator_rows(MONTH, MONTH),
        top_originator_cte(),
        outlet_by="customer",
    ),
    "display_launch": query(
        shown(
            "launches",
            f"rank, dci, {percent('share')} AS share_text, {BAND} AS band, CAST(focus_qty AS VARCHAR) AS focus_text, "
            "CAST(competitor_qty AS VARCHAR) AS competitor_text, CAST(originator_qty AS VARCHAR) AS originator_text",
        ),
        launch_cte(FIRST, MONTH),
    ),
    "display_molecules": query(
        shown(
            "card",
            f"sort_order, is_total, molecule, CAST(focus_qty AS VARCHAR) AS focus_qty_text, "
            f"CAST(other_qty AS VARCHAR) AS other_qty_text, {money('focus_value')} AS focus_value_text, "
            f"{money('other_value')} AS other_value_text, {percent('share')} AS share_text, {BAND} AS band",
        ),
        molecule_cte("card", START, END),
    ),
    "display_gaps": query(
        f"""SELECT outlet_id, {money('gap_30')} AS gap_30_text, {money('gap_50')} AS gap_50_text
        FROM ({gap_columns('card')})""",
        molecule_cte("card", START, END),
    ),
    "display_totals": query(
        f"""SELECT outlet_id, {money('switch_total')} AS switch_total_text,
        {money('originator_total')} AS originator_total_text, {money('margin')} AS margin_text FROM ({MARGIN})""",
        *totals(START, END),
    ),
    "report_flat": query(REPORT_FLAT, *REPORT_CTES),
    "report_totals": query(REPORT_TOTALS, *REPORT_CTES[:1], *totals(MONTH, MONTH), *REPORT_CTES[-2:]),
    "run_status": query("SELECT * FROM status", REPORT_CTES[0], STATUS),
    "run_summary": query(
        """SELECT count(*) FILTER (WHERE status = 'OK') AS n_ok,
        count(*) FILTER (WHERE status LIKE '%ERREUR%') AS n_err,
        'Bilan de l''envoi des rapports du 1998-06-30' || chr(10)
        || ' - Envoyés OK : ' || count(*) FILTER (WHERE status = 'OK') || chr(10)
        || ' - En erreurs : ' || count(*) FILTER (WHERE status LIKE '%ERREUR%') || chr(10) || chr(10)
        || 'Détails des erreurs :' || chr(10)
        || CASE WHEN count(*) FILTER (WHERE status LIKE '%ERREUR%') = 0 THEN 'Aucune erreur rencontrée.' ELSE '' END AS text
        FROM status""",
        REPORT_CTES[0],
        STATUS,
    ),
    "error_text": query(
        f"""SELECT {MONTH} AS period, n.outlet_id, 'ID=' || n.outlet_id || ' | Email=' || coalesce(b.mail, 'NA')
            || ' | Statut=ERREUR: ' || CASE WHEN o.outlet_id IS NULL THEN 'outlet not found' ELSE 'no mail address' END AS line
        FROM (SELECT DISTINCT o_custkey % 40 AS outlet_id FROM orders) n LEFT JOIN outlet o ON o.outlet_id = n.outlet_id
        LEFT JOIN outlet_master m ON m.outlet_id = n.outlet_id LEFT JOIN member b ON b.finess = m.finess
        WHERE o.outlet_id IS NULL OR b.mail IS NULL"""
    ),
    "outlet_quota": f"WITH {AREA} SELECT area_id, population, outlets, allowed FROM quota",
    "quota_gap": f"WITH {AREA} SELECT * FROM gap",
    "population_corr": f"""WITH {AREA} SELECT count(*) AS areas, round(corr(outlets, population), 6) AS correlation,
        round(regr_slope(outlets, population), 6) AS slope, round(regr_intercept(outlets, population), 6) AS intercept
        FROM area""",
    "density_bands": f"""WITH {AREA}, placed AS (
        SELECT *, cume_dist() OVER (ORDER BY inhabitants_per_outlet) AS below FROM gap
        WHERE inhabitants_per_outlet IS NOT NULL),
    edges AS (
        SELECT i, (SELECT min(inhabitants_per_outlet) FROM placed WHERE below >= i / 5.0) AS edge
        FROM range(1, 5) t(i))
    SELECT *, CASE WHEN inhabitants_per_outlet IS NOT NULL
        THEN CAST(1 + (SELECT count(*) FROM edges WHERE edge < inhabitants_per_outlet) AS INTEGER) END AS band
    FROM gap""",
}

ORACLE["report_committed"] = ORACLE["report_totals"]
ORACLE["bucketed_top_switch"] = ORACLE["split_top_switch"] = ORACLE["top_switch_customers"]
ORACLE["split_top_originator"] = ORACLE["top_originator_customers"]
ORACLE["split_margin_total"] = ORACLE["margin_total_customers"]
ORACLE["observed_key_checks"] = f"SELECT * FROM ({ORACLE['key_checks']}) WHERE table_name = 'sales'"

PART_NAMES = "SELECT p_partkey AS article_id, p_name || '#' || CAST(p_size AS VARCHAR) AS name FROM part"
ORACLE["first_rules"] = f"""WITH named AS ({PART_NAMES}),
rules AS (
    SELECT p_partkey AS sort_order, split_part(p_name, ' ', 2) || '#' || CAST(p_size % 10 AS VARCHAR) AS include,
        split_part(p_name, ' ', 1) AS exclude FROM part),
first AS (
    SELECT name, min(sort_order) AS sort_order FROM (SELECT DISTINCT name FROM named) n
    JOIN rules ON contains(upper(name), upper(include)) AND NOT contains(upper(name), upper(exclude)) GROUP BY name)
SELECT article_id, n.name, sort_order FROM named n LEFT JOIN first f ON f.name = n.name"""
ORACLE["starting_with"] = f"""WITH named AS ({PART_NAMES}),
prefixes AS (
    SELECT DISTINCT substring(p_name, 1, length(split_part(p_name, ' ', 1)) + p_size - 47) AS prefix FROM part WHERE p_size >= 49)
SELECT article_id, name FROM named WHERE EXISTS (SELECT 1 FROM prefixes WHERE starts_with(upper(name), upper(prefix)))"""
