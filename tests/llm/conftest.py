from __future__ import annotations

import pytest
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

#: Names that the operators use inside.
CLASHES = ["row", "id", "fingerprint", "part", "high", "score", "n_lines", "tokens", "copies", "time", "place", "kept", "term"]
CLASHES += ["items", "hits", "runs", "kind", "copy", "words", "a b", "c-d", "e.f", "g`h"]

SCHEMA = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        *(StructField(name, StringType()) for name in CLASHES),
    ]
)

LINE = "this very line is repeated over quite a few documents, word by word"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))

#: (doc_id, text, lang): nulls, empty and very long texts, copies, repeated rows, a null id twice.
ODD = [
    (1, None, None),
    (2, "", "en"),
    (3, " \t\r\n", "en"),
    (4, LONG, "en"),
    (5, LONG, "de"),
    (6, f"{LINE}\nsome words of the sixth", "en"),
    (7, f"the seventh\n  {LINE.upper()}\t\nwith words", "en"),
    (8, f"{LINE}\n{LINE}\n", "en"),
    (9, f"{LINE}", None),
    (10, f"ten\n{LINE}\r", "en"),
    (10, f"ten\n{LINE}\r", "en"),
    (10, "ten again, with another text", "fr"),
    (11, "1234 5678 !!", "en"),
    (12, "▁ é 😀 \x00 日本 �", "es"),
    (12, "▁ é 😀 \x00 日本 �", "es"),
    (None, f"{LINE}\nno id", "en"),
    (None, None, None),
]

#: (item_id, text): nulls, empty and short items, one without an id, repeats, a very long item.
ODD_ITEMS = [
    (1, None),
    (2, ""),
    (3, "?!"),
    (4, LINE),
    (4, LINE),
    (5, f"Before it: {LINE.upper()}, and behind it"),
    (6, "THE... seventh"),
    (7, " ".join(f"word{i % 977}x{i % 31}" for i in range(59_000, 59_011))),
    (8, LONG),
    (None, "some words"),
]

#: (vec_id, embedding, label): nulls, empty, short, not finite, repeated rows and ids, ties.
ODD_VECTORS = [
    (0, [0.5, -0.25, 1.0], 1),
    (0, [0.5, -0.25, 1.0], 1),
    (50, [0.5, -0.25, 1.0], 1),
    (100, [0.5, 0.5, 0.5], 2),
    (100, [0.25, 0.5, 0.5], 2),
    (1, [1.0, 1.0, 1.0], 1),
    (2, [1.0, 1.0, 1.0], 1),
    (3, [0.9, 0.9, 0.5], 2),
    (4, [0.5, 0.5, 0.5], 3),
    (5, [0.5, 0.5, 0.5], 3),
    (7, [0.8, 0.1, 0.1], 9),
    (8, None, 1),
    (9, [], 1),
    (10, [1.0, None, 1.0], 1),
    (11, [1.0, float("nan"), 1.0], 2),
    (12, [1.0, float("inf"), 1.0], 2),
    (13, [1.0, 1.0], 1),
    (14, [1.0, 1.0, 1.0], None),
    (None, [1.0, 1.0, 1.0], 1),
    (200, [1.0, 2.0], 1),
]


@pytest.fixture
def documents(spark):
    def make(rows=ODD):
        full = [(i, t, lang, None, len(t or ""), *["x"] * len(CLASHES)) for i, t, lang in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame(
            rows, StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())])
        )

    return make


@pytest.fixture
def corpus(spark):
    def read(scale, name="documents"):
        return spark.read.parquet(f"/root/testdata/sf{scale}/{name}.parquet")

    return read


@pytest.fixture
def folder(spark, tmp_path, documents, labels):
    """A folder of documents, labels, benchmark items and embeddings, as the queries take it."""
    items = StructType([StructField("item_id", LongType()), StructField("text", StringType()), *(StructField(c, StringType()) for c in CLASHES)])
    vectors = StructType(
        [StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", IntegerType())]
        + [StructField(c, StringType()) for c in (*CLASHES, "vector")]
    )

    def write(
        doc_rows=ODD,
        label_rows=((6, 1, 0), (7, 0, 0), (8, None, 1), (9, 1, None), (None, 1, 1), (99, 0, 1)),
        item_rows=ODD_ITEMS,
        vector_rows=ODD_VECTORS,
    ):
        spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in item_rows], items).write.parquet(f"{tmp_path}/benchmark.parquet")
        wide = [(*r, *["x"] * (len(CLASHES) + 1)) for r in vector_rows]
        spark.createDataFrame(wide, vectors).write.parquet(f"{tmp_path}/embeddings.parquet")
        documents(doc_rows).write.parquet(f"{tmp_path}/documents.parquet")
        labels(list(label_rows)).write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write
