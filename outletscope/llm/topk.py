"""Exact top-k by inner product over a bit-sliced index.

Rows are packed in blocks. A block's index holds, per dimension, bit planes over its rows of the quantised component.
A query's components, quantised too, say how often each plane counts; planes of equal weight are added with
carry-save adders on whole bitmaps, which gives a vertical sum per row. The k-th best sum is read off from the most
significant slice downward. Every row whose sum is within the proven rounding error of it is a boundary row and is
scored exactly, so nothing is lost to quantisation.

Cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null id.
Vectors of different lengths are compared only with their like. Rows with the query's own id are no candidates; other
rows that repeat a vector are, ties going to the smaller id. A row that repeats an id and vector counts once. Queries
with fewer candidates return them all. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outletscope.llm.common import checkpointed, partitions_of

SCALE = 1024
K = 10
#: Rows of a block and queries of a block; slices of a component, bits of a query's weights.
ROWS, QUERIES, SLICES, WEIGHT_BITS = 16_384, 256, 5, 6


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as long; null where the vector takes no part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, whole)


def sliced(matrix: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Bit planes (dimension, slice, words) of coarse = (x - low) >> shift; coarse, low per dimension, shift."""
    low = matrix.min(axis=0)
    span = int((matrix.max(axis=0) - low).max())
    shift = max(0, span.bit_length() - slices)
    coarse = (matrix - low) >> shift
    bits = (coarse.T[:, None, :] >> np.arange(slices)[None, :, None] & 1).astype(np.uint8)
    padded = np.zeros((*bits.shape[:2], -(-len(matrix) // 64) * 64), dtype=np.uint8)
    padded[:, :, : len(matrix)] = bits
    return np.packbits(padded, axis=2, bitorder="little").view(np.uint64), coarse, low, shift


def added(addends: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Vertical sum, lowest slice first, of bitmaps listed by the power of two they count for.

    Three bitmaps of a weight become a sum of that weight and a carry of the next, all threes of a weight at once.
    """
    out = []
    weight = 0
    rows = {w: np.stack(x) for w, x in addends.items() if len(x)}
    words = next(iter(rows.values())).shape[1]
    while rows:
        now = rows.pop(weight, np.zeros((0, words), np.uint64))
        carries = [rows.pop(weight + 1)] if weight + 1 in rows else []
        while len(now) > 2:
            third = len(now) // 3
            a, b, c = now[:third], now[third : 2 * third], now[2 * third : 3 * third]
            either = a ^ b
            carries.append((a & b) | (either & c))
            now = np.concatenate([either ^ c, now[3 * third :]])
        if len(now) == 2:
            carries.append((now[0] & now[1])[None])
            now = (now[0] ^ now[1])[None]
        out.append(now[0] if len(now) else np.zeros(words, np.uint64))
        if carries:
            rows[weight + 1] = np.concatenate(carries)
        weight += 1
    return out


def popcount(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def kth(sums: list[np.ndarray], among: np.ndarray, k: int) -> int:
    """The k-th largest vertical sum among the rows of a bitmap, found from the most significant slice downward."""
    sure, ties, value = 0, among, 0
    for bit in reversed(range(len(sums))):
        with_bit = ties & sums[bit]
        count = popcount(with_bit)
        if sure + count >= k:
            ties, value = with_bit, value | 1 << bit
        else:
            sure, ties = sure + count, ties & ~sums[bit]
    return value


def at_least(sums: list[np.ndarray], value: int) -> np.ndarray:
    """Bitmap of the rows whose vertical sum is value or more."""
    full = ~np.uint64(0)
    if value <= 0:
        return np.full_like(sums[0], full)
    if value >> len(sums):
        return np.zeros_like(sums[0])
    above, equal = np.zeros_like(sums[0]), np.full_like(sums[0], full)
    for bit in reversed(range(len(sums))):
        if value >> bit & 1:
            equal = equal & sums[bit]
        else:
            above |= equal & sums[bit]
            equal = equal & ~sums[bit]
    return above | equal


class Index:
    """A block's bit-sliced index and its exact components."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, slices: int = SLICES):
        self.ids, self.matrix = ids, matrix
        self.planes, coarse, low, self.shift = sliced(matrix, slices)
        self.top = (1 << slices) - 1
        step = 1 << self.shift
        rest = (matrix - low - coarse * step).astype(float) - (step - 1) / 2
        self.rest_norm = float(np.sqrt((rest**2).sum(axis=1).max()))
        middle = coarse - self.top / 2
        self.coarse_norm = float(np.sqrt((middle**2).sum(axis=1).max()))
        everyone = np.zeros(self.planes.shape[2] * 64, dtype=np.uint8)
        everyone[: len(ids)] = 1
        self.everyone = np.packbits(everyone, bitorder="little").view(np.uint64)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and exact scores of the k best rows (and of all that tie with the last), best first."""
        candidates = self.everyone
        mine = np.flatnonzero(self.ids == own)
        if len(mine):
            candidates = candidates.copy()
            for i in mine:
                candidates[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        if popcount(candidates) > k:
            candidates = candidates & self.near(query, candidates, k)
        bits = np.unpackbits(candidates.view(np.uint8), bitorder="little")
        rows = np.flatnonzero(bits)
        scores = self.matrix[rows] @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[order], scores[order]

    def near(self, query: np.ndarray, candidates: np.ndarray, k: int) -> np.ndarray:
        """Bitmap of the rows that may be among the k best.

        score = sum(q * (low + step * c + rest)), c the coarse component. With q = unit * w + e and w small and whole,
        sum(w * c) is what the bitmaps add up (for negative w, |w| * (top - c)); it differs from the score's varying
        part, in units of unit * step, by |q| |rest| / (unit * step) + |e| |c| / unit at most (Cauchy-Schwarz; constants
        of the query do not matter).
        """
        unit = max(1.0, float(np.abs(query).max()) / ((1 << WEIGHT_BITS) - 1))
        weights = np.rint(query / unit).astype(np.int64)
        left = query - unit * weights
        step = 1 << self.shift
        error = np.linalg.norm(query.astype(float)) * self.rest_norm / (unit * step) + np.linalg.norm(left) * self.coarse_norm / unit
        addends: dict[int, list[np.ndarray]] = {}
        for d in np.flatnonzero(weights):
            planes = self.planes[d] if weights[d] > 0 else ~self.planes[d]
            weight = abs(int(weights[d]))
            for j in range(weight.bit_length()):
                if weight >> j & 1:
                    for b, plane in enumerate(planes):
                        addends.setdefault(j + b, []).append(plane)
        if not addends:
            return candidates
        sums = added(addends)
        return at_least(sums, kth(sums, candidates, k) - int(np.ceil(2 * error * (1 + 1e-9))) - 1)


def _blocks(size: int):
    """Rows of a partition packed to blocks of a size at most, by vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def pack(dim: int) -> pa.RecordBatch:
            ids, vectors = held.pop(dim)
            row = {
                "dim": pa.array([dim], pa.int32()),
                "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                "vectors": pa.array([np.concatenate(vectors).astype(np.int64).tobytes()], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for vec_id, vector in zip(batch.column("id").to_pylist(), batch.column("vector")):
                values = vector.values.to_numpy(zero_copy_only=False)
                ids, vectors = held.setdefault(len(values), ([], []))
                ids.append(vec_id)
                vectors.append(values)
                if len(ids) >= size:
                    yield pack(len(values))
        for dim in list(held):
            yield pack(dim)

    return run


def _searched(k: int, slices: int):
    """The k best rows of a block for each query; a block's row comes before the queries that are sent to it."""

    def matrix(row: dict) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(row["ids"], np.int64)
        return ids, np.frombuffer(row["vectors"], np.int64).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if not row["asks"]:
                    index = Index(*matrix(row), slices)
                    continue
                queries, vectors = matrix(row)
                found = [(q, *index.best(v, q, k)) for q, v in zip(queries.tolist(), vectors)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": pa.array(np.repeat(queries, [len(r) for _, r, _ in found])),
                        "vec_id": pa.array(np.concatenate([index.ids[r] for _, r, _ in found])),
                        "score": pa.array(np.concatenate([s for *_, s in found]).astype(np.int64)),
                    }
                )

    return run


def packed(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of distinct rows. Sorted first, so that a partition computed anew gives the same blocks."""
    clean = vectors.where("id IS NOT NULL AND vector IS NOT NULL").select("id", "vector").distinct()
    return clean.sortWithinPartitions("id", "vector").mapInArrow(_blocks(size), "dim int, ids binary, vectors binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, slices: int = SLICES, rows: int = ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows.

    vectors and queries: id long and vector, whole numbers as array<long>. Every block of queries meets every block
    of rows: a block of rows, a few MB, is sent once, and the queries stream past it. A query's result of a block is k
    rows. Blocks are written to the shared folder first, so their numbers outlive a lost executor.
    """
    blocks = checkpointed(packed(vectors, rows).withColumn("block", F.monotonically_increasing_id()))
    numbers = blocks.select("dim", "block")  # a row of 12 bytes for each block
    asked = packed(queries, QUERIES).join(F.broadcast(numbers), "dim")
    columns = ("block", "ids", "vectors")
    met = blocks.select(*columns, F.lit(False).alias("asks")).union(asked.select(*columns, F.lit(True).alias("asks")))
    dealt = met.repartition(partitions_of(vectors), "block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(_searched(k, slices), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
