"""Context-triggered piecewise hashes: a rolling hash over the text sets chunk borders, each chunk gives a letter.

A border falls behind a character where the hash of the last WINDOW code units leaves the largest remainder of the
block size, so an edit moves only the borders around it. The block size follows from the length, and is halved while it
gives few chunks and doubled while it gives more than LETTERS. Where the next size would give few, as in text that
repeats itself, the last letter stands for all the rest. A fingerprint holds the letters at the block size and at
twice of it: "size:letters:letters of twice the size". Two fingerprints are compared where they have a block size in common, by the
edit distance of the letters; the likeness is 1 - distance / longer length, the better of two common sizes, and 0
where there is none.

Cases: a null or empty text has the fingerprint "3::"; two empty ones are alike by 1, an empty one and another by 0.
Equal texts have equal fingerprints. In id order, ties are broken by text and null ids come first, so repeated rows
follow each other. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outletscope.llm.common import partitions_of, slices

WINDOW = 7
SMALLEST = 3
LETTERS = 64
FEW = LETTERS // 4
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
MULTIPLIER = np.uint32(0x01000193)


def rolling(codes: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW codes at every place, mixed so that remainders are even."""
    total = np.zeros(len(codes), dtype=np.uint32)
    for back in reversed(range(min(WINDOW, len(codes)))):
        total *= MULTIPLIER
        total[back:] += codes[: len(codes) - back] + np.uint32(1)
    total ^= total >> np.uint32(15)
    total *= np.uint32(0x85EBCA6B)
    total ^= total >> np.uint32(13)
    return total


def fingerprint(text: str) -> str:
    if not text:
        return f"{SMALLEST}::"
    raw = text.encode("utf-32-le", "surrogatepass")
    hashes = rolling(np.frombuffer(raw, dtype="<u4"))
    size = SMALLEST
    while size * LETTERS < len(text):
        size *= 2

    def letters(size: int, borders: np.ndarray) -> str:
        cuts = [0, *(borders + 1).tolist()]
        if cuts[-1] < len(text):
            cuts.append(len(text))
        return "".join([ALPHABET[zlib.crc32(raw[4 * a : 4 * b]) & 63] for a, b in zip(cuts, cuts[1:])])

    def hits(size: int) -> np.ndarray:
        return np.flatnonzero(hashes % np.uint32(size) == size - 1)

    borders = hits(size)
    while len(borders) < FEW and size > SMALLEST:
        size //= 2
        borders = hits(size)
    while True:  # twice the size has no other borders: its remainder is the largest only where this one's is
        coarse = borders[hashes[borders] % np.uint32(2 * size) == 2 * size - 1]
        if len(borders) < LETTERS or len(coarse) < FEW or size >= 1 << 30:
            return f"{size}:{letters(size, borders[: LETTERS - 1])}:{letters(2 * size, coarse[: LETTERS - 1])}"
        size, borders = 2 * size, coarse


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distances of many pairs of short strings at once."""
    width = max(map(len, right), default=0)
    a_len, b_len = (np.array([len(x) for x in s], dtype=np.int64) for s in (left, right))
    height = int(a_len.max(initial=0))
    a = np.array([list(x.encode().ljust(height, b"\0")) for x in left], dtype=np.uint8).reshape(len(left), height)
    b = np.array([list(x.encode().ljust(width, b"\1")) for x in right], dtype=np.uint8).reshape(len(right), width)
    steps = np.arange(width + 1, dtype=np.int16)
    row = np.tile(steps, (len(left), 1))
    out = row[np.arange(len(left)), b_len].astype(np.int64)
    for i in range(height):
        best = np.empty_like(row)
        best[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i : i + 1] != b), out=best[:, 1:])
        # letters inserted one after the other: the least of best[j'] + j - j'
        row = (np.minimum.accumulate(best - steps, axis=1) + steps).astype(np.int16)
        done = np.flatnonzero(a_len == i + 1)
        out[done] = row[done, b_len[done]]
    return out


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness (0 to 1) of many pairs of fingerprints."""
    of, a, b = [], [], []
    out = np.zeros(len(left))
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[i] = 1.0
            continue
        (m, *xs), (n, *ys) = x.split(":"), y.split(":")
        mine, other = ({int(k) << j: s for j, s in enumerate(v)} for k, v in ((m, xs), (n, ys)))
        for size in mine.keys() & other.keys():
            if mine[size] and other[size]:
                of.append(i)
                a.append(mine[size])
                b.append(other[size])
    if of:
        longer = np.array([max(len(x), len(y)) for x, y in zip(a, b)])
        np.maximum.at(out, of, 1 - distances(a, b) / longer)
    return out


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by the beginning of another."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def with_following(docs: DataFrame, parts: int) -> DataFrame:
    """part, doc_id, text, tail: rows in order within each part, each part ending with its follower's first row (tail).

    Texts are shuffled once, by ranges of the id. A part's first row, one row per part, is sent to the part before it,
    the first of all to the last.
    """
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    bounds = sorted(set(ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)))
    above = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(above)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), part.alias("part"))
    least = docs.select("doc_id", part.alias("part")).groupBy("part").agg(F.min("doc_id").alias("first_id"))
    order = Window.orderBy("part")
    last = F.max("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = least.select("first_id", F.col("part").alias("head_of"), F.coalesce(F.lag("part").over(order), last).alias("to"))
    # a row per part: a bounded table
    found = rows.join(F.broadcast(heads), (F.col("part") == F.col("head_of")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    first = found.groupBy("to").agg(F.min_by(F.struct("doc_id", "text"), "text").alias("first"))
    tails = first.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text").alias("text"), F.col("to").alias("part"))
    both = rows.withColumn("tail", F.lit(False)).unionByName(tails.withColumn("tail", F.lit(True)))
    id_order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    return both.repartition(partitions_of(docs), "part").sortWithinPartitions("part", "tail", *id_order)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every text; edited_sha256, edited_fingerprint of its edited text (see `edited`);
    near_edited, near_next: likeness of its fingerprint to the edited text's and to the next document's."""
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which waits for the next
        for batch in slices(batches):
            done = []
            for part, doc_id, text, tail in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "tail"))):
                own = fingerprint(text)
                if held is not None and held[0] == part:
                    changed = edited(held[2], text)
                    done.append(
                        (held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(), held[3], fingerprint(changed), own)
                    )
                held = None if tail else (part, doc_id, text, own)
            ids, chars, digests, mine, changed, following = zip(*done) if done else ([], [], [], [], [], [])
            columns = [
                pa.array(ids, pa.int64()),
                pa.array(chars, pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(mine, pa.string()),
                pa.array(changed, pa.string()),
                pa.array(likeness(mine, changed), pa.float64()),
                pa.array(likeness(mine, following), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return with_following(docs, 4 * partitions_of(docs)).mapInArrow(run, schema)
