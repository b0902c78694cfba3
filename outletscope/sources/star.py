"""An order star schema (customers, orders, line items, parts) seen as the domain.

Customers' nations, or the customers themselves, are the outlets; parts are the articles and brands the labs.
Sales stay at line level: the operators add them up.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outletscope.constants import HOLIDAYS_2025, MoleculeRule
from outletscope.functions.periods import month_after, month_key, month_start
from outletscope.sources.domain import Domain

FOCUS_LAB = "Brand#1"
AS_OF = date(1998, 6, 30)
REPORT_GROUP = 1
MIN_SHARE = 0.05
COMPLETE_ORDERS = 8
HOLIDAYS = tuple(day.replace(year=year) for year in range(1994, 2003) for day in HOLIDAYS_2025)

RULES = (
    MoleculeRule(1, "rod", "ROD", "rod", "red"),
    MoleculeRule(2, "rod red", "ROD RED", "rod red"),
    MoleculeRule(3, "ring", "RING", "ring"),
    MoleculeRule(4, "bolt", "BOLT", "bolt"),
    MoleculeRule(5, "gear", "GEAR", "gear"),
    MoleculeRule(6, "widget", "WIDGET", "widget"),
)
PREFIXES = ("rod", "ring", "bolt", "gear", "widget")


# the columns read, declared so that no file is opened for its schema
COLUMNS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT",
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE",
}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{directory}/{name}.parquet")


def padded(key: Column) -> Column:
    """At least five digits, and all of them for a longer key."""
    digits = key.cast("string")
    return F.lpad(digits, F.greatest(F.lit(5), F.char_length(digits)), F.lit("0"))


class Star:
    """One method per domain table; facts are limited to the months ``start`` to ``end``."""

    def __init__(
        self,
        spark: SparkSession,
        directory: str,
        start: int | None,
        end: int | None,
        outlet_by: str,
        tables: Mapping[str, DataFrame] = {},
    ):
        self.spark, self.directory, self.start, self.end = spark, directory, start, end
        self.tables, self.by_customer = tables, outlet_by == "customer"

    def table(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else table(self.spark, self.directory, name)

    # --- facts

    def orders(self) -> DataFrame:
        """o_orderkey, outlet_id, period.

        Whole months are cut on the order date itself, so that the files are filtered, and orders find their
        outlet before the line items join them.
        """
        orders, day = self.table("orders"), F.col("o_orderdate")
        if self.start is not None:
            orders = orders.filter(day >= F.lit(month_start(self.start)).cast("timestamp_ntz"))
        if self.end is not None:
            orders = orders.filter(day < F.lit(month_after(self.end)).cast("timestamp_ntz"))
        outlet_id = F.col("o_custkey")
        if not self.by_customer:
            customer = self.table("customer").select("c_custkey", "c_nationkey")
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            outlet_id = F.col("c_nationkey").cast("bigint")
        return orders.select("o_orderkey", outlet_id.alias("outlet_id"), month_key(day).alias("period"))

    def sales(self) -> DataFrame:
        lines = self.table("lineitem").select(
            "l_orderkey", F.col("l_partkey").alias("article_id"), F.col("l_quantity").cast("bigint").alias("qty")
        )
        joined = lines.join(self.orders(), F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select("outlet_id", "article_id", "period", "qty")

    collection = sales

    def completeness(self) -> DataFrame:
        ok = F.when(F.count("*") >= COMPLETE_ORDERS, 1).otherwise(0)
        return self.orders().groupBy("outlet_id", "period").agg(ok.alias("ok"))

    # --- outlets

    def outlet(self) -> DataFrame:
        nation = self.table("nation")
        if self.by_customer:
            named = self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            key, name, town = F.col("c_custkey"), F.col("c_name"), F.col("n_name")
        else:
            named = nation.join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            key, name, town = F.col("n_nationkey"), F.col("n_name"), F.col("r_name")
        return named.select(
            key.cast("bigint").alias("outlet_id"),
            name.alias("name"),
            padded(key).alias("postcode"),
            town.alias("town"),
        )

    def crm(self) -> DataFrame:
        return self.outlet().select("outlet_id", F.concat(F.lit("P"), "postcode").alias("code"))

    def outlet_master(self) -> DataFrame:
        return self.outlet().select("outlet_id", F.concat(F.lit("F"), "postcode").alias("finess"))

    def member(self) -> DataFrame:
        mail = F.concat(F.lit("outlet"), F.col("outlet_id").cast("string"), F.lit("@example.org"))
        with_mail = self.outlet().filter(F.col("outlet_id") % 6 != 0)
        return with_mail.select(F.concat(F.lit("F"), "postcode").alias("finess"), mail.alias("mail"))

    def outlet_group(self) -> DataFrame:
        group_no = F.when(F.col("outlet_id") % 4 == 1, 2).otherwise(1)
        return self.outlet().select("outlet_id", group_no.alias("group_no"))

    # --- catalogue

    def parts(self) -> DataFrame:
        """Parts with every derived column of the article tables; each table reads the few it needs."""
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("article_id"),
            F.col("p_brand").alias("lab"),
            F.element_at(F.array(*map(F.lit, "PGARB")), (key % 5 + 1).cast("int")).alias("type"),
            F.concat("p_name", F.lit("#"), (F.col("p_size") % 4).cast("string")).alias("link_id"),
            F.col("p_size").alias("size"),
            F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
            (key + F.lit(3400000000000)).alias("ean"),
        )

    def links(self) -> DataFrame:
        """One row per link. Parts are grouped on raw columns, and texts derived from the few groups."""
        pack_no, name = (F.col("p_size") % 4).alias("pack_no"), F.col("p_name")
        groups = self.table("part").groupBy("p_name", pack_no).agg(F.max("p_retailprice").alias("price"))
        pack = F.col("pack_no").cast("string")
        return groups.select(
            F.concat(name, F.lit("#"), pack).alias("link_id"),
            F.split_part(name, F.lit(" "), F.lit(1)).alias("word1"),
            F.split_part(name, F.lit(" "), F.lit(2)).alias("word2"),
            pack.alias("pack"),
            F.col("price").cast("decimal(12,2)").alias("group_price"),
        )

    def article(self) -> DataFrame:
        stopped_on = F.when(F.col("article_id") % 3 == 0, F.lit(date(1998, 1, 1)))
        return self.parts().select(
            "article_id", F.col("lab").alias("maker_lab"), "type", stopped_on.alias("stopped_on")
        )

    def offer(self) -> DataFrame:
        rebate = (F.col("size").cast("decimal(5,2)") / 100).cast("decimal(5,2)")
        valid_until = F.date_add(F.lit(date(1998, 1, 1)), (F.col("article_id") * 37 % 365).cast("int"))
        return self.parts().select(
            "article_id", "lab", "link_id", rebate.alias("rebate"), valid_until.alias("valid_until"), "type", "price"
        )

    def link_group(self) -> DataFrame:
        return self.links().select(
            "link_id",
            F.col("link_id").alias("group_id"),
            F.concat("word2", F.lit(" "), "word1").alias("short_label"),
            "pack",
            F.lit("").alias("volume"),
            F.lit(None).cast("string").alias("unit"),
            "group_price",
        )

    def article_group(self) -> DataFrame:
        return self.parts().select("article_id", F.col("link_id").alias("group_id"))

    def dci(self) -> DataFrame:
        return self.links().select(
            F.col("link_id").alias("group_id"),
            F.col("word2").alias("dci"),
            F.col("word1").alias("dose"),
            F.lit(None).cast("string").alias("form"),
        )

    def lab(self) -> DataFrame:
        return self.parts().select("lab").distinct().withColumn("lab_name", F.col("lab"))

    def ean(self) -> DataFrame:
        return self.parts().select("ean", "article_id")

    def excluded_ean(self) -> DataFrame:
        return self.parts().filter(F.col("article_id") % 17 == 0).select("ean")

    def launch_ean(self) -> DataFrame:
        return self.parts().filter(F.col("article_id") % 10 < 3).select("ean")

    def regulated_price(self) -> DataFrame:
        active = F.when(F.col("article_id") % 4 == 0, 0).otherwise(1)
        priced = self.parts().filter(F.col("article_id") % 7 != 0)
        return priced.select("article_id", "price", active.alias("active"))


def load_star(
    spark: SparkSession,
    directory: str,
    start: int | None = None,
    end: int | None = None,
    outlet_by: str = "nation",
    tables: Mapping[str, DataFrame] = {},
) -> Domain:
    """The domain over the star schema; ``outlet_by`` is ``"nation"`` or ``"customer"``, ``tables`` are read instead of files."""
    star = Star(spark, directory, start, end, outlet_by, tables)
    return Domain(lambda name: getattr(star, name)())


def holidays(spark: SparkSession, directory: str) -> DataFrame:
    """Holidays as a table: the days with orders that fall on the fixed list's day and month, in any year."""
    day = F.col("o_orderdate").cast("date")
    fixed = [f"{d:%m-%d}" for d in HOLIDAYS_2025]
    return table(spark, directory, "orders").filter(F.date_format(day, "MM-dd").isin(fixed)).select(day.alias("day")).distinct()


def areas(spark: SparkSession, directory: str) -> DataFrame:
    """area_id, population, outlets per nation: a hundred people per customer, an outlet per supplier."""
    customers = table(spark, directory, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    suppliers = table(spark, directory, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    nation = table(spark, directory, "nation").select("n_nationkey")
    return (
        nation.join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left")
        .select(
            F.col("n_nationkey").alias("area_id"),
            (F.coalesce("c", F.lit(0)) * 100).alias("population"),
            F.coalesce("s", F.lit(0)).alias("outlets"),
        )
    )
