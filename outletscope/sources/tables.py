"""Readers and writers of whole tables: Parquet folders, catalog tables, JDBC, the monthly sales table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Reader = Callable[[str], DataFrame]


def parquet_reader(spark: SparkSession, directory: str) -> Reader:
    return lambda table: spark.read.parquet(f"{directory}/{table}")


def catalog_reader(spark: SparkSession, names: Mapping[str, str]) -> Reader:
    """Tables or views by catalog name, such as ``prod.dbo.regulated_price``."""
    return lambda table: spark.table(names.get(table, table))


def jdbc_reader(
    spark: SparkSession, names: Mapping[str, str], options: Mapping[str, str], splits: Mapping[str, Mapping] = {}
) -> Reader:
    """Tables of a database; ``splits`` gives partitionColumn, bounds and numPartitions for large ones."""

    def read(table: str) -> DataFrame:
        reader = spark.read.format("jdbc").options(**options, **splits.get(table, {}))
        return reader.option("dbtable", names.get(table, table)).load()

    return read


# --- sinks --------------------------------------------------------------------


def summed_by_month(sales: DataFrame) -> DataFrame:
    """Sales summed to outlet, article and month."""
    return sales.groupBy("outlet_id", "article_id", "period").agg(F.sum("qty").alias("qty"))


def write_monthly_sales(sales: DataFrame, path: str) -> None:
    """Sales summed to outlet, article and month, stored by month.

    Ranges on month, outlet and article even out the tasks whatever outlet or article dominates, keep the
    files per month few, and let a reader skip files by outlet.
    """
    keys = ["period", "outlet_id", "article_id"]
    (
        summed_by_month(sales)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("period")
        .parquet(path)
    )


def read_monthly_sales(spark: SparkSession, path: str) -> DataFrame:
    schema = "outlet_id BIGINT, article_id BIGINT, qty BIGINT, period INT"
    return spark.read.schema(schema).parquet(path).select("outlet_id", "article_id", "period", "qty")


def write_report(report: DataFrame, path: str) -> None:
    """One row per outlet, stored by month; a rerun replaces its month only."""
    writer = report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("period").parquet(path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """An intermediate result written to a path all executors share and read back: computed once, safe on disk."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
