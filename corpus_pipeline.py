"""Documents to tokens in five stages, each applying one operator to all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's result to the shared folder and
hands the reread table on. All but the last return the columns of documents.

Cases: nulls, empty and repeated rows are handled as the operators' docstrings say. Rows with a null doc_id are rows like
others (their lines alone are not deduplicated), an empty table gives an empty result, further columns are passed through,
whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outletscope.llm import lines, mixing, pieces, simhash, toxicity
from outletscope.llm.common import quoted, shared_folder, table

#: Target shares of tokens by the labels' quality. Rates stay at 1 at least, so a target is met by repeating documents.
QUALITY_MIX = {"low": 0.1, "high": 0.9}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return found.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A text that loses lines gets a new n_chars; a text that loses none stays as it is, null included."""
    found = lines.deduplicated(docs)
    lost = F.col("n_dropped") > 0
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    columns = [
        F.when(lost, new[c]).otherwise(F.col("row").getField(c)).alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns
    ]
    return found.select(*columns)


def keyed(docs: DataFrame) -> DataFrame:
    """Rows as struct `row`, with the id and the hash of the text that tell them apart."""
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")
    return docs.select(row, F.col("doc_id").alias("own_id"), simhash.text_key().alias("own_key"))


def same_text(doc_id: str = "doc_id", text_key: str = "text_key") -> Column:
    return F.col("own_id").eqNullSafe(F.col(doc_id)) & (F.col("own_key") == F.col(text_key))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near texts one row stays: of its smallest doc_id, null after all others.

    Texts are grouped, not ids, so texts of a repeated doc_id that are near nothing all stay.
    """
    named = keyed(docs).join(simhash.first_of_groups(docs), same_text(), "left_semi")
    # rows that repeat both id and text
    order = Window.partitionBy("own_id", "own_key").orderBy(F.xxhash64(F.to_json("row")))
    return named.withColumn("place", F.row_number().over(order)).where("place = 1").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says."""
    labels = table(spark, sf_dir, "labels")
    quality = F.when(F.col("quality") > 0, "high").when(F.col("quality") <= 0, "low")
    found = mixing.mixed(docs, labels.select("doc_id", quality.alias("domain")), QUALITY_MIX, floor=1.0)
    copies = found.groupBy("doc_id", "text_key").agg(F.max("copies").alias("copies"))
    rows = keyed(docs).join(copies, same_text(), "left")
    times = F.coalesce(F.col("copies"), F.lit(1))
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), times))).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the tables in between are in the shared folder, one run in a folder of its own."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: A learned lexicon and classifier can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None
