"""The domain tables as one bundle of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from outletscope.sources.schemas import SCHEMAS, key_columns

Reader = Callable[[str], DataFrame]

FACTS = ("sales", "collection")


class Domain:
    """Tables by name, as attributes; a table is opened when an operator first asks for it."""

    sales: DataFrame
    collection: DataFrame
    article: DataFrame
    offer: DataFrame
    link_group: DataFrame
    article_group: DataFrame
    dci: DataFrame
    lab: DataFrame
    ean: DataFrame
    excluded_ean: DataFrame
    launch_ean: DataFrame
    regulated_price: DataFrame
    outlet: DataFrame
    crm: DataFrame
    outlet_master: DataFrame
    member: DataFrame
    completeness: DataFrame
    outlet_group: DataFrame

    def __init__(self, read: Reader, **tables: DataFrame):
        self._read = read
        self.__dict__.update(tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        table = self._read(name)
        setattr(self, name, table)
        return table

    def replaced(self, **tables: DataFrame) -> Domain:
        """The same domain with some tables exchanged."""
        return Domain(self.table, **tables)

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def create_views(self, prefix: str = "") -> None:
        """Register every table as a temporary view, for queries in SQL."""
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(prefix + name)

    def for_outlets(self, outlets: DataFrame) -> Domain:
        """The same domain for some outlets only: facts and the outlet list shrink, catalogues stay."""
        wanted = outlets.select("outlet_id")
        narrowed = (*FACTS, "outlet", "completeness")

        def read(name: str) -> DataFrame:
            table = self.table(name)
            return table.join(wanted, "outlet_id", "left_semi") if name in narrowed else table

        return Domain(read)


def required(c: Column, table: str, name: str) -> Column:
    """A column whose NULLs stop the job instead of changing a join."""
    return F.coalesce(c, F.raise_error(F.lit(f"NULL in key column {table}.{name}")))


def typed(df: DataFrame, table: str) -> DataFrame:
    """Columns of the declared schema, cast, with right padding of strings removed.

    Keys of the catalogue are checked as they are read. Fact keys are left bare so that filters on them
    reach the files; ``null_keys`` counts theirs. A fact with year and month columns gets its month key here.
    """
    if "period" in SCHEMAS[table].names and "period" not in df.columns:
        df = df.withColumn("period", F.col("year") * 100 + F.col("month"))

    def column(field: StructField) -> Column:
        c = F.col(field.name).cast(field.dataType)
        if isinstance(field.dataType, StringType):
            c = F.rtrim(c)
        if not field.nullable and table not in FACTS:
            c = required(c, table, field.name)
        return c.alias(field.name)

    return df.select(*[column(field) for field in SCHEMAS[table].fields])


def load_domain(read: Reader) -> Domain:
    """The domain over any reader of tables by name (see ``tables.py``)."""
    return Domain(lambda name: typed(read(name), name))


def null_keys(domain: Domain) -> DataFrame:
    """Rows and NULLs of each key column: one aggregate per table."""

    def counted(table: str) -> DataFrame:
        keys = key_columns(table)
        nulls = [F.count_if(F.col(k).isNull()).alias(k) for k in keys]
        counts = domain.table(table).agg(F.count("*").alias("rows"), *nulls)
        pairs = F.array(*[F.struct(F.lit(k).alias("key_column"), F.col(k).alias("nulls")) for k in keys])
        return counts.select(F.lit(table).alias("table_name"), "rows", F.inline(pairs))

    return reduce(DataFrame.unionByName, [counted(table) for table in SCHEMAS])


def observed_keys(domain: Domain, table: str = "sales") -> tuple[Domain, Observation]:
    """The domain with a table whose rows and NULL keys are counted by the very job that reads it.

    ``observed_nulls`` gives the counts once an action has read the table to its end.
    """
    seen = Observation(f"keys of {table}")
    nulls = [F.count_if(F.col(k).isNull()).alias(k) for k in key_columns(table)]
    return domain.replaced(**{table: domain.table(table).observe(seen, F.count("*").alias("rows"), *nulls)}), seen


def observed_nulls(spark: SparkSession, seen: Observation, table: str = "sales") -> DataFrame:
    """What ``null_keys`` gives for the table, out of the counts of the job that read it: a row per key column."""
    counts = seen.get
    pairs = [F.struct(F.lit(k).alias("key_column"), F.lit(counts[k]).cast("bigint").alias("nulls")) for k in key_columns(table)]
    rows = F.lit(counts["rows"]).cast("bigint").alias("rows")
    return spark.range(1).select(F.lit(table).alias("table_name"), rows, F.inline(F.array(*pairs)))
