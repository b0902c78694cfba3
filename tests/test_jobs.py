"""Invariants, batch against single outlet, sinks, report and plans."""

from __future__ import annotations

import re
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from outletscope.operators import areas, joins, launches, molecules, offers
from outletscope.operators.joins import global_rank
from outletscope.functions.numbers import share_fits, share_percent
from outletscope.plans import queries as q
from outletscope.plans import report as reports
from outletscope.sources import star, tables
from outletscope.sources.domain import load_domain
from tests.tables import rows

DIR = "/root/testdata/sf0.01"
D = Decimal


@pytest.fixture(scope="module")
def domain(spark):
    return star.load_star(spark, DIR, q.START, q.END)


def card(domain, start=q.START, end=q.END):
    return molecules.molecule_scorecard(domain, q.LAB, start, end, star.RULES, star.PREFIXES)


# --- invariants


def test_top_values_stay_within_the_total(domain):
    top = offers.top_switch(domain, q.LAB, q.AS_OF, q.START, q.END).groupBy("outlet_id").agg(F.sum("value").alias("top"))
    total = offers.switch_total(domain, q.LAB, q.AS_OF, q.START, q.END)
    assert top.join(total, "outlet_id").filter("top > value").count() == 0


def test_unlimited_top_adds_up_to_the_total(domain):
    top = offers.top_switch(domain, q.LAB, q.AS_OF, q.START, q.END, k=10_000)
    summed = top.groupBy("outlet_id").agg(F.sum("value").cast("decimal(20,2)").alias("value"))
    assert rows(summed, "outlet_id", "value") == rows(offers.switch_total(domain, q.LAB, q.AS_OF, q.START, q.END))


def test_molecule_total_is_the_sum_of_its_details(domain):
    measures = ("focus_qty", "other_qty", "focus_value", "other_value")
    sums = card(domain).groupBy("outlet_id", "is_total").agg(*[F.sum(m).alias(m) for m in measures])
    detail, total = (rows(sums.filter(F.col("is_total") == t), "outlet_id", *measures) for t in (False, True))
    assert detail == total and len(total) == 25


def test_month_is_a_range_of_one(domain):
    assert rows(card(domain, q.MONTH, None)) == rows(card(domain, q.MONTH, q.MONTH))


def test_batch_equals_single(spark, domain):
    one = spark.createDataFrame([(12,)], "outlet_id BIGINT")
    single = domain.for_outlets(one)
    for operator in (
        lambda d: offers.top_switch(d, q.LAB, q.AS_OF, q.START, q.END),
        lambda d: offers.margin_total(d, q.LAB, q.AS_OF, q.START, q.END),
        lambda d: launches.launch_scorecard(d, q.LAB, q.START, q.END),
        card,
    ):
        assert rows(operator(domain).filter("outlet_id = 12")) == rows(operator(single))


def test_launch_scorecard_equals_the_full_grid(domain):
    """All substances for all outlets, then the top: what the trimmed fill must give."""
    sold = launches.launch_sales(domain, q.LAB, q.MONTH, q.MONTH)
    grid = domain.outlet.select("outlet_id").crossJoin(launches.launched_substances(domain))
    full = grid.join(sold, ["outlet_id", "dci"], "left").fillna(0)
    expected = full.withColumn(
        "rank", F.expr("row_number() OVER (PARTITION BY outlet_id ORDER BY share DESC, dci)")
    ).filter("rank <= 3")
    columns = ("outlet_id", "rank", "dci", "focus_qty", "competitor_qty", "originator_qty")
    got = launches.launch_scorecard(domain, q.LAB, q.MONTH, q.MONTH, k=3)
    assert rows(got, *columns) == rows(expected, *columns)


# --- joins


def test_global_rank(spark):
    words = spark.createDataFrame([(w,) for w in ("b", "ab", "aa", "ca", "", "aab", "z")], "w STRING")
    ranked = global_rank(words, F.substring("w", 1, 1), "w")
    assert rows(ranked, "rank", "w") == [(i + 1, w) for i, w in enumerate(["", "aa", "aab", "ab", "b", "ca", "z"])]


def test_both_join_ways_agree(spark, domain):
    def results():
        return (
            rows(offers.top_switch(domain, q.LAB, q.AS_OF, q.START, q.END)),
            rows(offers.margin_total(domain, q.LAB, q.AS_OF, q.START, q.END)),
            rows(card(domain)),
            rows(launches.launch_scorecard(domain, q.LAB, q.START, q.END)),
        )

    broadcast = results()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert results() == broadcast
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- plans


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_no_cross_join_no_python(spark, capsys, name):
    plan = plan_of(q.QUERIES[name](spark, DIR), capsys)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in plan


def test_top_is_limited_before_its_shuffle(spark, capsys):
    plan = plan_of(q.QUERIES["top_switch"](spark, DIR), capsys)
    assert plan.count("WindowGroupLimit") >= 2


SOLD = ["top_switch", "top_originator", "switch_total", "originator_total", "margin_total", "molecule_range", "launch_scorecard"]


@pytest.mark.parametrize("name", SOLD)
def test_the_fact_is_cut_where_it_is_read(spark, name):
    """Only the filter of wanted articles is above the scan, and only its places are broadcast of our own accord."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = q.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    scans = [i for i, line in enumerate(lines) if "FileScan parquet [l_" in line]
    assert scans
    for scan in scans:
        depth = lines[scan].index("FileScan")
        above = []
        for line in reversed(lines[:scan]):
            start = len(line) - len(line.lstrip(" :+-"))
            if start < depth:
                above.append(line.lstrip(" :+-"))
                depth = start
        names = [re.match(r"\w+", line)[0] for line in above]
        semi = names.index("BroadcastHashJoin")
        assert set(names[:semi]) <= {"Filter", "Project", "ColumnarToRow"}
        assert "wanted_place" in above[semi] and "LeftSemi" in above[semi]
        grouped = next(line for line in above[semi:] if line.startswith("HashAggregate"))
        assert "keys=[outlet_id" in grouped and "article_id" in grouped
    assert plan.count("BroadcastHashJoin") == len(scans)


def test_a_filter_too_full_still_gives_all(domain, monkeypatch):
    """Articles that share a place with a wanted one pass the filter and end at the join."""
    wanted = rows(offers.top_switch(domain, q.LAB, q.AS_OF, q.START, q.END))
    monkeypatch.setattr(joins, "PLACES", 3)
    assert rows(offers.top_switch(domain, q.LAB, q.AS_OF, q.START, q.END)) == wanted


def test_a_hot_article_weighs_as_many_rows_as_there_are_outlets(spark):
    """A third of all lines on one article: what is shuffled is a row per task, outlet and article."""
    lines = spark.range(0, 200_000, 1, 8).select(
        (F.col("id") % 20).alias("outlet_id"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5_000).cast("bigint").alias("article_id"),
        F.lit(1).cast("bigint").alias("qty"),
    )
    items = spark.range(5_000).select(F.col("id").alias("article_id"))
    cells = joins.sell(lines, items)
    assert cells.where("article_id = 7").count() == 20
    sizes = [r["count"] for r in cells.repartition(4, "article_id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_period_reaches_the_files(spark, capsys):
    plan = plan_of(q.QUERIES["molecule_month"](spark, DIR), capsys)
    assert "GreaterThanOrEqual(o_orderdate,1998-06-01T00:00)" in plan
    assert "LessThan(o_orderdate,1998-07-01T00:00)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan


# --- sources and sinks


def test_monthly_sales_round_trip(spark, domain, tmp_path, capsys):
    path = str(tmp_path / "sales")
    tables.write_monthly_sales(domain.sales, path)
    back = tables.read_monthly_sales(spark, path)
    expected = domain.sales.groupBy("outlet_id", "article_id", "period").agg(F.sum("qty").alias("qty"))
    assert rows(back, "outlet_id", "article_id", "period", "qty") == rows(expected, "outlet_id", "article_id", "period", "qty")
    plan = plan_of(back.filter("period = 199806"), capsys)
    assert "PartitionFilters: [isnotnull(period" in plan
    # results do not depend on the grain of the fact
    monthly = domain.replaced(sales=back, collection=back)
    assert rows(card(monthly)) == rows(card(domain))


def test_rewriting_a_month_keeps_the_others(spark, domain, tmp_path):
    path = str(tmp_path / "sales")
    tables.write_monthly_sales(domain.sales, path)
    before = tables.read_monthly_sales(spark, path).count()
    june = domain.sales.filter("period = 199806")
    tables.write_monthly_sales(june, path)
    assert tables.read_monthly_sales(spark, path).count() == before


def test_domain_from_parquet_trims_and_casts(spark, tmp_path):
    spark.createDataFrame([("7", "Dupont   ", "1", None)], "outlet_id STRING, name STRING, postcode STRING, town STRING").write.parquet(
        str(tmp_path / "outlet")
    )
    domain = load_domain(tables.parquet_reader(spark, str(tmp_path)))
    assert rows(domain.outlet) == [(7, "Dupont", "1", None)]


def test_month_key_out_of_year_and_month(spark):
    lines = spark.createDataFrame([(7, 1, 2025, 5, 3)], "outlet_id INT, article_id INT, year INT, month INT, qty INT")
    domain = load_domain(lambda name: lines)
    assert rows(domain.sales, "outlet_id", "period", "qty") == [(7, 202505, 3)]


def test_domain_from_catalog_names(spark):
    spark.createDataFrame([(1, "x ")], "lab INT, lab_name STRING").createOrReplaceTempView("labs_view")
    domain = load_domain(tables.catalog_reader(spark, {"lab": "labs_view"}))
    assert rows(domain.lab) == [("1", "x")]


# --- report


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    first, last = q.trailing_months(q.MONTH, q.TRAILING_MONTHS)
    domain = star.load_star(spark, DIR, min(first, q.SINCE), last)
    folder = str(tmp_path_factory.mktemp("report"))
    return tables.stored(reports.report_dataset(domain, q.REPORT, folder=folder), f"{folder}/report")


def test_report_has_every_table_for_each_outlet(report):
    assert report.count() == 4
    for r in report.collect():
        assert len(r["molecules"]) == len(r["molecules_since"]) == 7
        assert r["molecules"][-1]["molecule"] == "TOTAL"
        assert [x["rank"] for x in r["launches"]] == list(range(1, 9))
        assert r["margin"] == r["switch_total"] + r["originator_total"]
        assert r["label"].startswith("Pharmacie NATION_") and r["month"] == "Juin 1998"


def test_report_tables_equal_the_operators(spark, report):
    whole = star.load_star(spark, DIR, q.MONTH, q.MONTH)
    ids = [r[0] for r in report.select("outlet_id").collect()]
    expected = offers.top_switch(whole, q.LAB, q.AS_OF, q.MONTH).filter(F.col("outlet_id").isin(ids))
    nested = report.select("outlet_id", F.inline("top_switch"))
    columns = ("outlet_id", "rank", "label", "lab_name", "qty", "value")
    assert rows(nested, *columns) == rows(expected, *columns)


def test_report_is_written_by_month(spark, report, tmp_path):
    path = str(tmp_path / "report")
    tables.write_report(report, path)
    tables.write_report(report.withColumn("period", F.lit(199807)), path)
    tables.write_report(report, path)
    assert rows(spark.read.parquet(path).groupBy("period").count()) == [(199806, 4), (199807, 4)]


def test_status_and_summary(spark):
    few = D("10.00")
    report = spark.createDataFrame(
        [(1, 202505, "L", "a@b", D(1), few), (2, 202505, None, "a@b", D(1), few), (3, 202505, "L", None, D(1), few),
         (1003, 202505, "L", "c@d", None, few), (2500, 202505, "L", "e@f", D(0), None), (9, 202505, "L", "g@h", D(1), D("1e10"))],
        "outlet_id BIGINT, period INT, label STRING, mail STRING, margin DECIMAL(20,2), total_share DECIMAL(28,2)",
    )
    status = reports.run_status(report)
    assert rows(status, "outlet_id", "status") == [
        (1, "OK"), (1003, "ERREUR: totals missing"), (2, "ERREUR: outlet not found"), (2500, "OK"),
        (3, "ERREUR: no mail address"), (9, "ERREUR: share out of range"),
    ]
    text = "Bilan de l'envoi des rapports du 2025-06-17\n - Envoyés OK : {}\n - En erreurs : {}\n\nDétails des erreurs :\n"
    assert rows(reports.run_summary(status, date(2025, 6, 17))) == [(2, 4, text.format(2, 4))]
    without = text.format(0, 0) + "Aucune erreur rencontrée."
    assert rows(reports.run_summary(status.filter("false"), date(2025, 6, 17))) == [(0, 0, without)]
    assert rows(reports.error_lines(status)) == [
        (202505, 1003, "ID=1003 | Email=c@d | Statut=ERREUR: totals missing"),
        (202505, 2, "ID=2 | Email=a@b | Statut=ERREUR: outlet not found"),
        (202505, 3, "ID=3 | Email=NA | Statut=ERREUR: no mail address"),
        (202505, 9, "ID=9 | Email=g@h | Statut=ERREUR: share out of range"),
    ]


@pytest.mark.parametrize("name", ["report_totals", "run_status"])
def test_the_report_reads_the_fact_once(spark, name):
    plan = q.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_") == 1


def test_an_amount_beyond_a_long_stays_with_its_outlet(spark):
    month = star.load_star(spark, DIR, q.MONTH, q.MONTH)
    huge = F.when(F.col("outlet_id") == 3, F.lit(2**62)).otherwise(F.col("qty"))
    domain = month.replaced(sales=month.sales.withColumn("qty", huge), collection=month.collection.withColumn("qty", huge))
    asked = spark.createDataFrame([(2, "a@b"), (3, "c@d"), (4, "e@f")], "outlet_id BIGINT, mail STRING")
    found, plain = (reports.status_inputs(d, q.REPORT, asked) for d in (domain, month))
    assert rows(reports.run_status(found), "outlet_id", "status") == [(2, "OK"), (3, "ERREUR: amount out of range"), (4, "OK")]
    assert rows(found.filter("outlet_id <> 3")) == rows(plain.filter("outlet_id <> 3"))


def test_returns_do_not_stop_other_outlets(spark):
    """Nearly all sales returned: the share is far out of range, and only that outlet's."""
    money = spark.createDataFrame([(D("1000000.00"), D("0.01")), (D("1.00"), D("4.00"))], "focus DECIMAL(20,2), whole DECIMAL(20,2)")
    share = share_percent(F.col("focus"), F.col("whole"))
    assert rows(money.select(share, share_fits(share))) == [(D("10000000000.00"), False), (D("25.00"), True)]


def test_building_a_query_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    for name in ("top_switch", "launch_scorecard", "molecule_month", "monthly_sales", "report_totals", "run_status", "density_bands"):
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        q.QUERIES[name](spark, DIR)
        assert len(tracker.getJobIdsForGroup(f"build-{name}")) == 0, name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_since_window_must_not_be_empty(domain):
    params = reports.ReportParams(as_of=date(2025, 2, 17), period=202501)
    with pytest.raises(ValueError):
        reports.report_dataset(domain, params)


# --- areas


def test_quota_gap_and_bands(spark):
    units = spark.createDataFrame(
        [(1, 2499, 1), (2, 7000, 1), (3, 11500, 5), (4, 5000, 0)], "area_id INT, population BIGINT, outlets BIGINT"
    )
    assert rows(areas.quota_gap(units), "area_id", "allowed", "surplus", "inhabitants_per_outlet") == [
        (1, 0, 1, 2499.0),
        (2, 2, -1, 7000.0),
        (3, 3, 2, 2300.0),
        (4, 1, -1, None),
    ]
    assert rows(areas.density_bands(units, n=3), "area_id", "band") == [(1, 2), (2, 3), (3, 1), (4, None)]


def test_bands_of_many_areas_are_exact(spark, duck):
    """Far more areas than a quantile sketch holds exactly, many of them equal."""
    units = spark.range(60_000).select(
        F.col("id").cast("int").alias("area_id"),
        (F.xxhash64("id") % 900_000 + 900_000).alias("population"),
        (F.col("id") % 7).alias("outlets"),
    )
    found = {r["area_id"]: (r["inhabitants_per_outlet"], r["band"]) for r in areas.density_bands(units).collect()}
    values = sorted(v for v, _ in found.values() if v is not None)
    n = len(values)
    edges = [values[-(-n * i // 5) - 1] for i in range(1, 5)]
    assert all(band == (None if v is None else 1 + sum(e < v for e in edges)) for v, band in found.values())


def test_population_correlation_is_exact_on_a_line(spark):
    units = spark.createDataFrame([(i, 1000 * i, 2 * i + 1) for i in range(1, 9)], "area_id INT, population BIGINT, outlets BIGINT")
    found = areas.population_correlation(units).first()
    assert found["areas"] == 8
    assert found["correlation"] == pytest.approx(1.0)
    assert found["slope"] == pytest.approx(0.002)
    assert found["intercept"] == pytest.approx(1.0)
