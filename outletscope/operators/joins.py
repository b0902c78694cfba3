"""How the sales fact meets the article catalogue, and how rows are ranked per outlet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outletscope.operators.hot import split_join


#: Places that articles are told by in the filter of a fact: its rows at most, at every size of the catalogue.
PLACES = 1 << 20


def place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PLACES))


def of_wanted(sales: DataFrame, items: DataFrame) -> DataFrame:
    """Sales of a catalogue's articles, and of few others that share a place with one, cut where the fact is read.

    The places of the wanted articles are no more than PLACES, whatever the catalogue holds, so they may be broadcast and
    the fact is filtered in its own tasks, before any shuffle. A join with the catalogue ends the few others.
    """
    places = items.select(place(F.col("article_id")).alias("wanted_place")).distinct()
    return sales.join(F.broadcast(places), place(F.col("article_id")) == F.col("wanted_place"), "left_semi")


def sell(sales: DataFrame, items: DataFrame, *by: str, hot: DataFrame | None = None) -> DataFrame:
    """Sales of the catalogue's articles, summed to outlet and article (and further columns of the sales, such as the
    month), with the catalogue's rows.

    One plan at every size. The fact is cut to the wanted articles where it is read; what is left is joined and summed
    in parts before it is shuffled on outlet and article, so a best-seller weighs as many rows as there are outlets. How
    the sums meet the catalogue is left to the optimizer. Every measure is linear in the quantity, so summing first
    changes nothing. ``hot``: articles (see ``hot.frequent``) whose sums are dealt over many tasks for that join.
    """
    kept = of_wanted(sales.select("outlet_id", "article_id", *by, "qty"), items)
    cells = kept.groupBy("outlet_id", "article_id", *by).agg(F.sum("qty").alias("qty"))
    if hot is None:
        return cells.join(items, "article_id")
    return split_join(cells, items, "article_id", [F.col(c) for c in ("outlet_id", *by)], hot)


def in_period(sales: DataFrame, start: int, end: int | None = None) -> DataFrame:
    return sales.filter(F.col("period").between(start, start if end is None else end))


def top_per_outlet(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each outlet; ``order`` must be total."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy("outlet_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def global_rank(df: DataFrame, bucket: Column, *order: str) -> DataFrame:
    """``df`` with its rank, from 1, in the order of the given columns; no task sorts everything.

    ``bucket`` follows the order: rows of a lower bucket come first. Only the counts of the buckets meet in one place.
    """
    placed = df.withColumn("_bucket", bucket)
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    earlier = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
    ranked = placed.withColumn("_inside", inside).join(before, "_bucket")
    return ranked.withColumn("rank", F.col("_inside") + F.col("_before")).drop("_bucket", "_inside", "_before")
