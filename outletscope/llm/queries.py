"""One query per operator, over the whole of its table, with production parameters; SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outletscope.llm import contamination, language, lines, mixing, negatives, periodic, piecewise, pieces, sharding, simhash
from outletscope.llm import token_counts, topk, toxicity
from outletscope.llm.common import table

#: Target shares of tokens by language, and in each by the labels' quality.
LANGUAGE_MIX = {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12}
QUALITY_MIX = {"low": 0.1, "high": 0.9}
MIX = {f"{lang}_{quality}": a * b for lang, a in LANGUAGE_MIX.items() for quality, b in QUALITY_MIX.items()}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    quality = F.when(F.col("quality") > 0, "high").when(F.col("quality") <= 0, "low")
    marks = table(spark, sf_dir, "labels").join(documents.select("doc_id", "lang"), "doc_id")
    found = mixing.mixed(documents, marks.select("doc_id", F.concat_ws("_", "lang", quality).alias("domain")), MIX)
    return found.drop("text_key").withColumnsRenamed({f"p_{i}": f"p_{name}" for i, name in enumerate(MIX)})


def op2_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), rule="most")


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.byte_shards(table(spark, sf_dir, "documents"))
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.fingerprinted(table(spark, sf_dir, "documents"))


def op8_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    vectors = embeddings.select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 100 == 0))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_of(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return found.select("row.doc_id", "held_out", "score", predicted.alias("predicted"))


def op11_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, by a hash of the id, the text repeats itself from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    read = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumns(
        {"g": F.floor(h / 10), "words": F.when(h % 10 == 0, words)}
    )
    n, g = F.size("words"), F.col("g")
    start = (g % n).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", start + 1, period), F.ceil((n - start) / period).cast("int")))
    whole = F.concat(F.slice("words", F.lit(1), start), F.slice(again, F.lit(1), n - start))
    return read.select("doc_id", F.when(n > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(repeating(table(spark, sf_dir, "documents")), keep=["doc_id"])
    # the longest run, ties by smallest start, then period
    ranks = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("rate")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", F.array_max(ranks))
    return best.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        "best.length",
        (-F.col("best.rate")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.rate")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = embeddings.select(F.col("vec_id").alias("id"), label.alias("label"), topk.quantised(F.col("embedding"), 256).alias("vector"))
    return negatives.hard_negatives(vectors, vectors.where(F.col("id") % 50 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_section_tokens,
        op3_byte_shards,
        op4_pieces,
        op5_simhash,
        op6_line_dedup,
        op7_piecewise,
        op8_bit_sliced,
        op9_language,
        op10_toxicity,
        op11_contamination,
        op12_periodic_runs,
        op13_hard_negatives,
    )
}

BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE: dict[str, str] = {
    "op6_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, line, position, trim(line, {BLANKS}) AS stripped
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS position FROM documents)
), keyed AS (
  SELECT *, translate(stripped, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id < f.last_doc AS dropped FROM keyed k LEFT JOIN frequent f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op8_bit_sliced": """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
""",
    "op11_contamination": r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + 9], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT k FROM windows
), grams AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM texts, sizes WHERE len(w) >= k)
), matches AS (
  SELECT g.doc_id, g.k, g.i, d.item_id FROM grams g JOIN windows d USING (k, gram)
), hit AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS word FROM matches) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM matches WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT t.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op13_hard_negatives": """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other_id) <= 3
""",
}
