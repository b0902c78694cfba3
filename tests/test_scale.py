"""Heavy hitters, rules as tables, bucketed facts, key checks while reading."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from outletscope.functions.text import classify_molecule, starts_with_any
from outletscope.constants import MoleculeRule
from outletscope.operators import hot, joins, offers, rules
from outletscope.plans import queries as q
from outletscope.sources import star
from outletscope.sources.domain import load_domain, null_keys, observed_keys, observed_nulls
from outletscope.sources.layout import write_bucketed
from outletscope.sources.tables import summed_by_month
from tests.tables import rows

DIR = "/root/testdata/sf0.01"


@pytest.fixture
def plain_joins(spark):
    """No adaptive execution, no broadcast by the optimizer, 16 shuffle partitions."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


# --- heavy hitters


def lines_with_a_hot_article(spark):
    """35 % of all lines on article 7, sold by every outlet."""
    return spark.range(0, 300_000, 1, 8).select(
        (F.col("id") % 40_009).alias("outlet_id"),
        F.when(F.col("id") % 100 < 35, 7).otherwise(F.xxhash64("id") % 20_000).cast("bigint").alias("article_id"),
        F.lit(1).cast("bigint").alias("qty"),
    )


def task_sizes(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_frequent_articles_are_found(spark):
    found = rows(hot.frequent(lines_with_a_hot_article(spark), "article_id", k=3))
    assert (7,) in found and len(found) <= 3
    nothing = spark.createDataFrame([(None,)], "article_id BIGINT")
    assert rows(hot.frequent(nothing, "article_id")) == []


def test_a_hot_article_is_dealt_over_all_tasks(spark, plain_joins):
    """Without adaptive execution; the plain join leaves it to one task."""
    lines = lines_with_a_hot_article(spark)
    items = spark.range(-20_000, 20_000).select(F.col("id").alias("article_id"), (F.col("id") * 2).alias("cents"))
    split = joins.sell(lines, items, hot=hot.frequent(lines, "article_id", k=8))
    plain = joins.sell(lines, items)
    sizes, unsplit = task_sizes(split), task_sizes(plain)
    assert sizes[-1] < 2 * sizes[len(sizes) // 2] and len(sizes) == 16
    assert unsplit[-1] > 2 * unsplit[len(unsplit) // 2]
    sums = [df.groupBy("article_id").agg(F.count("*"), F.sum("qty"), F.sum("cents")) for df in (split, plain)]
    assert rows(sums[0]) == rows(sums[1])


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("called_hot", [[], [1, 2], [1, 1, 9, None], list(range(8))])
def test_split_joins_equal_plain_joins(spark, how, called_hot):
    """Whatever keys are called hot: repeated rows on both sides, null keys, keys of one side only."""
    draw = random.Random(5)
    left = spark.createDataFrame([(draw.choice([None, *range(8)]), i % 30) for i in range(120)], "k BIGINT, v INT")
    right = spark.createDataFrame([(draw.choice([None, 1, 1, 2, 3, 5, 9]), i) for i in range(25)], "k BIGINT, w INT")
    marked = spark.createDataFrame([(k,) for k in called_hot], "k BIGINT")
    found = hot.split_join(left, right, "k", [F.col("v")], marked, salts=5, how=how)
    assert rows(found) == rows(left.join(right, "k", how))


# --- rules


LETTERS = "abAB# é"


def random_text(draw, longest):
    return "".join(draw.choices(LETTERS, k=draw.randint(0, longest)))


@pytest.mark.parametrize("seed", range(4))
def test_random_rules_against_the_expression(spark, seed):
    """Short, empty, null and repeated rules, ties, names that are null, empty and repeated, a further column."""
    draw = random.Random(seed)
    drawn = [MoleculeRule(draw.randint(1, 25), "", random_text(draw, 5), random_text(draw, 2)) for _ in range(30)]
    table = [(r.sort_order, r.include, r.exclude or draw.choice(["", None])) for r in drawn]
    table += [table[3], (0, None, None), (0, "", "x")]
    names = [(i, draw.choice([None, "", random_text(draw, 12), random_text(draw, 12)])) for i in range(200)]
    frame = spark.createDataFrame([*names, names[0]], "piece INT, label STRING")
    found = rules.first_rules(frame, "label", spark.createDataFrame(table, "sort_order INT, include STRING, exclude STRING"))
    wanted = frame.withColumn("sort_order", classify_molecule(F.col("label"), [r for r in drawn if r.include]))
    assert rows(found) == rows(wanted)

    prefixes = [random_text(draw, 4) for _ in range(12)]
    starts = spark.createDataFrame([(p,) for p in [*prefixes, prefixes[0], None, ""]], "prefix STRING")
    kept = [p for p in prefixes if p]
    assert rows(rules.starting_with(frame, "label", starts)) == rows(frame.filter(starts_with_any(F.col("label"), kept)))


def test_no_rules_and_no_names(spark):
    names = spark.createDataFrame([("a",), (None,)], "name STRING")
    none = spark.createDataFrame([], "sort_order INT, include STRING, exclude STRING")
    assert rows(rules.first_rules(names, "name", none)) == [("a", None), (None, None)]
    assert rows(rules.first_rules(names.limit(0), "name", none)) == []
    assert rows(rules.starting_with(names, "name", spark.createDataFrame([], "prefix STRING"))) == []


def test_ten_thousand_rules_make_no_longer_plan(spark):
    names = q.part_names(spark, DIR)

    def plan(n):
        table = spark.range(n).select(F.col("id").alias("sort_order"), F.format_string("ring#%d", "id").alias("include"), F.lit("").alias("exclude"))
        found = rules.first_rules(names, "name", table)
        return found, found._jdf.queryExecution().optimizedPlan().toString().count("\n")

    (few, short), (many, long) = plan(10), plan(10_000)
    assert short == long
    wanted = names.withColumn("sort_order", F.regexp_extract("name", r"ring#(\d)", 1)).filter("sort_order <> ''")
    # ring#1 comes before ring#11, so the first digit decides
    expected = wanted.withColumn("sort_order", F.col("sort_order").cast("bigint"))
    assert rows(many.filter("sort_order IS NOT NULL")) == rows(expected) == rows(few.filter("sort_order IS NOT NULL"))


def test_rules_with_the_same_texts_meet_names_once(spark, monkeypatch):
    """Names meet as many rules as there are texts; rows out of an explode are never broadcast by the table's size."""
    met = []
    meet = rules.split_join
    monkeypatch.setattr(rules, "split_join", lambda left, right, *a, **b: met.append(right) or meet(left, right, *a, **b))
    names = spark.range(300).select(F.col("id"), F.format_string("ring#%d", F.col("id") % 30).alias("name"))
    nth = F.col("id") % 10
    table = spark.range(1000).select(
        (F.lit(2000) - F.col("id")).alias("sort_order"),
        F.format_string("RING#%d", nth).alias("include"),
        F.when(nth == 2, "#21").alias("exclude"),
    )
    found = rules.first_rules(names, "name", table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    on_pieces = [line for line in plan.splitlines() if "HashJoin" in line and ("_part" in line or "[names#" in line)]
    assert not on_pieces and any("SortMergeJoin" in line and "_part" in line for line in plan.splitlines()), plan
    digit = F.substr("name", F.lit(6), F.lit(1)).cast("bigint")
    first = F.when(F.col("name") != "ring#21", F.lit(1010) - digit).alias("sort_order")
    assert rows(found) == rows(names.select("id", "name", first))
    assert met[0].count() == 10


# --- buckets


def test_buckets_meet_without_an_exchange(spark, plain_joins, tmp_path):
    laid = {
        name: write_bucketed(star.table(spark, DIR, name), f"laid_{name}", str(tmp_path / name), key, 6)
        for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"))
    }
    try:
        domain = star.load_star(spark, DIR, q.START, q.END, "customer", laid)
        plain = star.load_star(spark, DIR, q.START, q.END, "customer")
        plan = domain.sales._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SelectedBucketsCount: 6 out of 6" in plan
        assert "Exchange" in plain.sales._jdf.queryExecution().executedPlan().toString()
        assert rows(summed_by_month(domain.sales)) == rows(summed_by_month(plain.sales))
        top = offers.top_switch(domain, q.LAB, q.AS_OF, q.START, q.END)
        lines = top._jdf.queryExecution().executedPlan().toString().splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "l_orderkey" in line)
        above, depth = [], lines[scan].index("FileScan")
        for line in reversed(lines[:scan]):
            start = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if start < depth:
                above.append(line.lstrip(" :+-*()0123456789").split(" ")[0])
                depth = start
        assert "Exchange" not in above[: above.index("SortMergeJoin")], above
        assert len(list((tmp_path / "lineitem").glob("*.parquet"))) <= 6
    finally:
        for name in laid:
            spark.sql(f"DROP TABLE laid_{name}")


# --- key checks


def test_keys_are_checked_by_the_job_that_reads(spark, make_domain):
    domain = make_domain(sales=[(1, 5, 202501, 3), (None, 5, 202501, 3), (None, None, 202502, 1)])
    watched, seen = observed_keys(domain)
    assert rows(summed_by_month(watched.sales)) == rows(summed_by_month(domain.sales))
    found = observed_nulls(spark, seen)
    expected = null_keys(domain).filter("table_name = 'sales'").select(*found.columns)
    assert rows(found) == rows(expected) and ("sales", 3, "outlet_id", 2) in rows(found)


def test_checking_keys_reads_the_fact_once(spark):
    domain, _ = observed_keys(load_domain(star.load_star(spark, DIR).table))
    plan = summed_by_month(domain.sales)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CollectMetrics") == 1 and plan.count("FileScan parquet [l_") == 1
