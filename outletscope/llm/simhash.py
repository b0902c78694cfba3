"""SimHash near-duplicates: fingerprints of word shingles, linked within a number of differing bits.

Fingerprints that differ in at most r of 64 bits agree on at least two of r + 2 bands of bits. Only fingerprints that
share a pair of bands are compared: about 21 bits for a radius of 4, so that buckets stay small where one band's 13 bits
would give thousands of members. They are compared bit-sliced: bit planes stored vertically, distances of many
candidates kept in carry-save counters, queries given up once every candidate exceeds the radius.

Cases: a null or empty text, or one without words, has fingerprint zero and links like any other. Equal texts have
equal fingerprints, so copies collapse to one before anything is compared. A null doc_id is no document: its row
comes back with its fingerprint, links nothing, and has a null component. Rows that repeat a doc_id belong to the
component of each of their fingerprints. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletscope.llm.common import checkpointed
from outletscope.llm.components import components

WORDS = 4
RADIUS = 4
BITS = 64
SEED = 42
#: Members of whole buckets compared at once; a bucket of over BUCKET members is compared in blocks of BLOCK.
TILE, BLOCK, BUCKET = 512, 2048, 4096

ONE = np.uint64(1)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text, as an unsigned number."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    n = max(1, len(found) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], s) for a, b, s in zip(starts, stops, repeat(SEED))], dtype=np.uint64)
    set_in = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 14):  # 64 bytes of unpacked bits per shingle
        part = hashes[at : at + (1 << 14)]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > n, bitorder="little").view("<u8")[0])


def text_key() -> Column:
    """Tells the texts of rows that repeat a doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_key and fingerprint (as a signed long) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(found.view(np.int64))], ["doc_id", "text_key", "fingerprint"]
            )

    read = docs.select("doc_id", text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, text_key long, fingerprint long")


def carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three rows of bits."""
    either = a ^ b
    return either ^ c, (a & b) | (either & c)


def over(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """The bits whose vertical counter (lowest slice first) exceeds radius."""
    above = np.zeros_like(counter[0])
    equal = np.full_like(counter[0], ~np.uint64(0))
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            above |= equal & counter[k]
            equal &= ~counter[k]
    return above


def planes(values: np.ndarray) -> np.ndarray:
    """The bit planes of the fingerprints: row b holds bit b of all of them, 64 to a word, the last word filled up."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    width = -(-len(values) // 64) * 64
    padded = np.zeros((BITS, width), dtype=np.uint8)
    padded[:, : len(values)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def within(left: np.ndarray, right: np.ndarray, radius: int, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs' left members that have partners, and for each its partners as a row of booleans.

    With upper, left and right are the same and only pairs (i, j) with i < j count.
    """
    if not 0 <= radius < 8:
        raise ValueError("the counters hold distances below 8")
    sliced = planes(right)
    inside = np.ones((len(left), len(right)), dtype=bool)
    if upper:
        inside = np.triu(inside, 1)
    padded = np.zeros((len(left), sliced.shape[1] * 64), dtype=np.uint8)
    padded[:, : len(right)] = inside
    dead = ~np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    alive = np.arange(len(left))
    ones, twos, fours = (np.zeros_like(dead) for _ in range(3))
    for group in range(0, BITS, 8):
        # all ones where the query's bit is set, so that a plane is flipped there
        flips = [(np.uint64(0) - (left[alive] >> np.uint64(b) & ONE))[:, None] for b in range(group, group + 8)]
        rows = [sliced[b][None, :] ^ flip for b, flip in zip(range(group, group + 8), flips)]
        ones, a = carry_save(ones, rows[0], rows[1])
        ones, b = carry_save(ones, rows[2], rows[3])
        twos, c = carry_save(twos, a, b)
        ones, a = carry_save(ones, rows[4], rows[5])
        ones, b = carry_save(ones, rows[6], rows[7])
        twos, d = carry_save(twos, a, b)
        fours, eights = carry_save(fours, c, d)
        dead |= eights | over([ones, twos, fours], radius)
        kept = (dead != ~np.uint64(0)).any(axis=1)
        if not kept.all():
            alive, dead, ones, twos, fours = alive[kept], dead[kept], ones[kept], twos[kept], fours[kept]
            if not len(alive):
                break
    linked = np.unpackbits((~dead).view(np.uint8), axis=1, bitorder="little")[:, : len(right)].astype(bool)
    return alive, linked


def forest(left: np.ndarray, right: np.ndarray, alive: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the pairs connect, fewer than left and right have members: never all pairs of a group."""
    out: list[tuple[int, int]] = []
    new_left, new_right = np.ones(len(alive), dtype=bool), np.ones(linked.shape[1], dtype=bool)
    for start in range(len(alive)):
        if not new_left[start]:
            continue
        new_left[start], todo = False, [start]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(linked[i] & new_right):
                new_right[j] = False
                out.append((int(left[alive[i]]), int(right[j])))
                for k in np.flatnonzero(linked[:, j] & new_left):
                    new_left[k] = False
                    out.append((int(left[alive[k]]), int(right[j])))
                    todo.append(int(k))
    return out


def links_within(values: np.ndarray, ids: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links among the members, by id."""
    alive, linked = within(values, values, radius, upper=True)
    return forest(ids, ids, alive, linked) if len(alive) else []


def links_between(left: np.ndarray, right: np.ndarray, left_ids: np.ndarray, right_ids: np.ndarray, radius: int):
    alive, linked = within(left, right, radius, upper=False)
    return forest(left_ids, right_ids, alive, linked) if len(alive) else []


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _tiles(radius: int):
    """Links in the buckets of a partition sorted by bucket; whole buckets of two or more are gathered to tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = {k: np.zeros(0, dtype=np.int64) for k in ("bucket", "fingerprint", "id")}

        def linked(lo: int, hi: int) -> list[tuple[int, int]]:
            return links_within(rest["fingerprint"][lo:hi].view(np.uint64), rest["id"][lo:hi], radius)

        for batch in batches:
            rest = {k: np.concatenate([v, _numbers(batch, k)]) for k, v in rest.items()}
            if not len(rest["id"]):
                continue
            turn = np.diff(rest["bucket"]) != 0
            # a member alone in its bucket has no partner; the last one's bucket may go on
            shared = ~(np.append(True, turn) & np.append(turn, False))
            rest = {k: v[shared] for k, v in rest.items()}
            ends = np.flatnonzero(np.diff(rest["bucket"])) + 1
            links, lo = [], 0
            while len(ends) and ends[-1] - lo >= TILE:
                hi = int(ends[np.searchsorted(ends, lo + TILE)])
                links += linked(lo, hi)
                lo = hi
            rest = {k: v[lo:] for k, v in rest.items()}
            yield _edges(links)
        yield _edges(linked(0, len(rest["id"])))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of BLOCK members of a bucket at most, each as one row of packed numbers; the input is sorted by bucket."""
    rest = {k: np.zeros(0, dtype=np.int64) for k in ("bucket", "fingerprint", "id")}

    def blocks(cut: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array([int(rest["bucket"][a]) for a, _ in cut], pa.int64()),
                "fingerprints": pa.array([rest["fingerprint"][a:b].tobytes() for a, b in cut], pa.binary()),
                "ids": pa.array([rest["id"][a:b].tobytes() for a, b in cut], pa.binary()),
            }
        )

    def cuts(ends: np.ndarray) -> list[tuple[int, int]]:
        firsts = [0, *ends[:-1].tolist()]
        return [(a, min(a + BLOCK, int(e))) for f, e in zip(firsts, ends) for a in range(f, int(e), BLOCK)]

    for batch in batches:
        rest = {k: np.concatenate([v, _numbers(batch, k)]) for k, v in rest.items()}
        ends = np.flatnonzero(np.diff(rest["bucket"])) + 1
        # of the last bucket, which may go on, whole blocks only
        last = int(ends[-1]) if len(ends) else 0
        whole = last + (len(rest["id"]) - last) // BLOCK * BLOCK
        ready = cuts(ends) + [(a, a + BLOCK) for a in range(last, whole, BLOCK)]
        yield blocks(ready)
        rest = {k: v[whole:] for k, v in rest.items()}
    if len(rest["id"]):
        yield blocks(cuts(np.array([len(rest["id"])])))


def _compared(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                left, right, a, b = (np.frombuffer(row[k], dtype=np.int64) for k in ("left", "right", "left_ids", "right_ids"))
                left, right = left.view(np.uint64), right.view(np.uint64)
                links = links_within(left, a, radius) if row["same"] else links_between(left, right, a, b, radius)
                if links:
                    yield _edges(links)

    return run


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect exactly the ids whose fingerprints are within radius bits, directly or by others.

    nodes: id and fingerprint, one row per fingerprint.
    """
    count = radius + 2
    edges = [round(BITS * i / count) for i in range(count + 1)]
    bands = [F.shiftrightunsigned("fingerprint", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])]
    # two buckets whose hashes agree are one larger bucket; distances decide
    keys = [F.xxhash64(F.lit(i), *pair) for i, pair in enumerate(combinations(bands, 2))]
    members = nodes.select(F.explode(F.array(*keys)).alias("bucket"), "fingerprint", "id")
    large = members.groupBy("bucket").count().where(F.col("count") > BUCKET).select("bucket")
    columns = "u long, v long"
    small = (
        members.join(large, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_tiles(radius), columns)
    )
    # the members of a large bucket are dealt out over salts, packed to blocks, and blocks are compared in pairs
    blocks = checkpointed(
        members.join(large, "bucket", "left_semi")
        .repartition("bucket", F.pmod(F.xxhash64("fingerprint"), F.lit(64)))
        .sortWithinPartitions("bucket")
        .mapInArrow(_packed, "bucket long, fingerprints binary, ids binary")
        .withColumn("block", F.monotonically_increasing_id())
    )
    right = blocks.select("bucket", *(F.col(c).alias(f"right_{c}") for c in ("fingerprints", "ids", "block")))
    paired = (
        blocks.join(right, "bucket")
        .where(F.col("block") <= F.col("right_block"))
        .select(
            F.col("fingerprints").alias("left"),
            F.col("right_fingerprints").alias("right"),
            F.col("ids").alias("left_ids"),
            F.col("right_ids").alias("right_ids"),
            (F.col("block") == F.col("right_block")).alias("same"),
            "block",
            "right_block",
        )
        .repartition("block", "right_block")
    )
    # a tile holds a member once for each of its buckets
    return small.unionByName(paired.mapInArrow(_compared(radius), columns)).where("u <> v")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (long) and component_id, the smallest doc_id reached over links, of every document."""
    marked = checkpointed(fingerprints(docs, words).drop("text_key"))
    nodes = marked.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("id"))
    found = components(links(nodes, radius))
    # a repeated doc_id with different texts joins their fingerprints' components
    named = nodes.join(found, nodes.id == found.node, "left").select(
        "fingerprint", F.coalesce("component", "id").alias("component_id")
    )
    return marked.join(named, "fingerprint", "left").select(
        "doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def first_of_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id and text_key of the text that stands for its group, a row per group: of the group's smallest doc_id.

    Texts are linked, not documents, so a doc_id with different texts does not join their groups. A null doc_id comes
    after all others; of texts of one doc_id the one with the smallest key stands.
    """
    marked = fingerprints(docs, words)
    place = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first")
    nodes = checkpointed(marked.groupBy("fingerprint").agg(place))
    found = components(links(nodes.select("fingerprint", F.col("fingerprint").alias("id")), radius))
    grouped = nodes.join(found, nodes.fingerprint == found.node, "left")
    first = grouped.groupBy(F.coalesce("component", "fingerprint")).agg(F.min("first").alias("first"))
    return first.select("first.doc_id", "first.text_key")
