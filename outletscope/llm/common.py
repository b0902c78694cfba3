"""What the operators share: the shared folder, packing of foreign columns, batches of texts."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Texts handed to numpy at once hold about so many characters; a longer text is handled alone.
BATCH_CHARS = 1 << 21

#: Documents whose crc32(doc_id as text) leaves this remainder of FOLDS are held out of training.
FOLDS, HELD_OUT = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own where it is unset and all runs on this machine."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder; their lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(id_column: str = "doc_id") -> Column:
    """True for the documents kept out of training; false where the id is null."""
    text = F.col(id_column).cast("string")
    return F.coalesce(F.pmod(F.crc32(text.cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def partitions_of(df: DataFrame) -> int:
    """How many partitions a shuffle makes in this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sampled(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most so many rows, chosen by a hash of the key; the rows stay where they are, only their keys are gathered.

    Rows that repeat a key go or stay together and count as one.
    """
    chosen = rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(most)
    return rows.join(F.broadcast(chosen), key, "left_semi")  # bounded by `most`


def present(rows: DataFrame, others: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is in others."""
    return rows.join(others.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def quoted(name: str) -> str:
    """A column's name as `F.col` takes it, blanks, dashes and dots included."""
    return "`" + name.replace("`", "``") + "`"


def packed_rows(docs: DataFrame, keep: list[str] | None = None, beside: list[str] = []) -> DataFrame:
    """The columns to keep (all, if not said) as struct `row`, others beside it; text beside it only where it isn't in
    there as a string."""
    kept = docs.columns if keep is None else keep
    row = F.struct(*[F.col(quoted(c)) for c in kept]).alias("row")
    if "text" in kept and docs.schema["text"].dataType == StringType():
        return docs.select(row, *beside)
    return docs.select(row, *beside, F.col("text").cast("string").alias("text"))


def row_schema(rows: DataFrame, more: str) -> StructType:
    """Struct `row` as in rows, and the columns of a DDL text behind it."""
    return StructType([rows.schema["row"], *StructType.fromDDL(more).fields])


def column_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A column of a batch, or the field of that name of its struct `row`."""
    return batch.column(column) if column in batch.schema.names else batch.column("row").field(column)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one hold about so many bytes."""
    for batch in batches:
        sizes = pc.binary_length(column_of(batch, column)).fill_null(0).to_pylist()
        first = taken = 0
        for i, size in enumerate(sizes):
            if taken and taken + size > chars:
                yield batch.slice(first, i - first)
                first, taken = i, 0
            taken += size
        if first < len(sizes):
            yield batch.slice(first)
