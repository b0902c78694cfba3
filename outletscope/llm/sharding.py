"""Contiguous shards of near equal byte size, cut from global prefix sums.

Rows are range-partitioned by id with their sizes only; each partition's totals give its offset in the global order
(a row per partition, the only thing that is gathered), and a running sum inside the partition gives every row its
place. A row belongs to the shard in whose byte range it begins.

Cases: a null or empty text has size 1. A null id sorts first; ties and repeated rows are ordered by size and checksum, so
that equal rows are interchangeable. A row larger than a shard's share leaves following shards empty. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outletscope.llm.common import checkpointed, partitions_of

SHARDS = 16


def byte_shards(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (its place in the shard, from 0) of every row, in id order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    order = ["doc_id", "size", "text_crc32"]
    rows = docs.select(
        F.col(id_column).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = checkpointed(
        rows.repartitionByRange(partitions_of(docs), *order).withColumn("part", F.spark_partition_id())
    )
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(everything).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.col("bytes_before") + F.sum("size").over(inside) - F.col("size")
    # a row per partition: a bounded table
    numbered = placed.join(F.broadcast(offsets), "part").select(
        *order,
        begin.alias("begin"),
        "all_bytes",
        (F.col("rows_before") + F.count("*").over(inside) - 1).alias("place"),
    )
    numbered = numbered.withColumn("shard", F.expr(f"cast(begin * {shards} div all_bytes AS int)"))
    firsts = numbered.groupBy("shard").agg(F.min("place").alias("first_place"))
    return numbered.join(F.broadcast(firsts), "shard").select(
        *order, "shard", (F.col("place") - F.col("first_place")).alias("slot")
    )
