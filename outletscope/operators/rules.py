"""Rules as tables: which rule a name falls under, whatever the number of rules.

The rules are rows and not branches of an expression, so a plan does not grow with them, and names meet rules by an
equi-join on a piece of text that both have instead of each with each.

Texts are compared in upper case. Names are classified once each, however many rows have them. A null name falls under no
rule; a rule with a null or empty text holds no name; a null or empty exclusion excludes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletscope.operators.hot import FREQUENT, frequent, split_join

#: Characters of the pieces that names and rules meet by; a shorter rule is its own piece.
GRAM = 3


def _pieces(text: Column, n: int) -> Column:
    """Every stretch of ``n`` characters, none for a shorter text."""
    starts = F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.char_length(text) - (n - 1)))
    return F.coalesce(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))), F.array().cast("array<string>"))


def _folded(name: str) -> Column:
    return F.upper(F.col(name))


def first_rules(df: DataFrame, name: str, rules: DataFrame) -> DataFrame:
    """``df`` with ``sort_order``: of the first rule whose ``include`` the name contains and whose ``exclude`` it does not.

    ``rules``: sort_order, include, exclude. Of rules with the same texts only the first can be a name's first, so names
    meet as many rules as there are texts. A rule is looked up by the rarest of its pieces among the names, so a common
    syllable makes no task long; pieces that are frequent all the same (a rule of one letter) are dealt over many tasks.
    Pieces come from an explode, so they meet by merge joins: nothing that grows with names or rules is broadcast.
    """
    names = df.select(F.col(name).alias("name")).filter("name IS NOT NULL").distinct().withColumn("folded", _folded("name"))
    every = F.flatten(F.array(*[_pieces(F.col("folded"), n) for n in range(1, GRAM + 1)]))
    held = names.withColumn("piece", F.explode(F.array_distinct(every)))
    counts = held.groupBy("piece").agg(F.count("*").alias("names"))

    texts = rules.select("sort_order", _folded("include").alias("include"), F.coalesce(_folded("exclude"), F.lit("")).alias("exclude"))
    texts = texts.filter("include <> ''").groupBy("include", "exclude").agg(F.min("sort_order").alias("sort_order"))
    own = F.when(F.char_length("include") < GRAM, F.array("include")).otherwise(_pieces(F.col("include"), GRAM))
    rarest = F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "piece"))
    looked_up = (
        texts.withColumn("piece", F.explode(F.array_distinct(own)))
        .join(counts.hint("merge"), "piece", "left")
        .groupBy("sort_order", "include", "exclude")
        .agg(rarest.alias("rarest"))
        .select("sort_order", "include", "exclude", "rarest.*")
        .filter("names > 0")
    )
    hot = looked_up.select("piece", "names").distinct().orderBy(F.desc("names"), "piece").limit(FREQUENT).select("piece")
    met = split_join(held, looked_up.drop("names"), "piece", [F.col("name")], hot, hint="merge")
    holds = F.contains("folded", "include") & ((F.col("exclude") == "") | ~F.contains("folded", "exclude"))
    first = met.filter(holds).groupBy("name").agg(F.min("sort_order").alias("sort_order"))
    return df.join(first.withColumnRenamed("name", name), name, "left").select(*df.columns, "sort_order")


def starting_with(df: DataFrame, name: str, prefixes: DataFrame) -> DataFrame:
    """The rows whose name starts with one of the table ``prefixes`` (column ``prefix``).

    A name is looked up once for each length that prefixes have.
    """
    wanted = prefixes.select(_folded("prefix").alias("prefix")).filter("prefix <> ''").distinct()
    lengths = wanted.agg(F.collect_set(F.char_length("prefix"))).scalar()  # no more than the longest prefix has characters
    names = df.select(F.col(name).alias("name")).filter("name IS NOT NULL").distinct()
    fitting = F.filter(F.col("lengths"), lambda n: n <= F.char_length("name"))
    starts = (
        names.withColumn("lengths", lengths)
        .select("name", F.explode(fitting).alias("n"))
        .select("name", F.substr(_folded("name"), F.lit(1), F.col("n")).alias("prefix"))
    )
    met = split_join(starts, wanted, "prefix", [F.col("name")], frequent(starts, "prefix"))
    return df.join(met.select(F.col("name").alias(name)).distinct(), name, "left_semi").select(*df.columns)
