"""Facts laid out for their join: tables bucketed and sorted on the key they share.

Lines and orders are shuffled on the order key once, when they are laid out; every later join of the two reads bucket by
bucket without an exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """``df`` as table ``name`` of the catalog, its files in ``path``; the table.

    A file a bucket, as rows are dealt by the same hash before they are written. Choose ``buckets`` by the larger of the
    tables, so that one of its buckets fits a task, and the same for all that are joined.
    """
    (
        df.repartition(buckets, key)
        .write.format("parquet")
        .mode("overwrite")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(name)
    )
    return df.sparkSession.table(name)
