"""Hard-negative mining by segment summaries.

A vector is cut into segments, and of each segment its mean and its deviation (the length of what is left without the
mean) are stored. In one segment the inner product of two vectors is the segment's length times the product of the means,
give or take the product of the deviations (Cauchy-Schwarz); summed over segments that bounds the score. Few long
segments are looked at first, those rows that can still count are looked at again in shorter segments, and what is left
is scored exactly.

Rows are dealt over parts by a hash. A part's rows lie in one task, in one copy, and the anchors stream past them, sorted
behind the rows. Positives come first, as best k of each part and then of all; with the bands of scores that they set,
the anchors pass by once more for the negatives.

Cases: rows with a null id or label, a null or empty vector take no part. A row that repeats id, label and vector counts
once; rows that repeat an id with another label or vector are rows of their own, an anchor each, and never partners of
their own id. Vectors of different lengths are compared only with their like. Ties go to the smaller id. Anchors with fewer
partners return what there is; a negative positive score leaves no band. Empty tables give an empty result. Scores must
fit a long. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outletscope.llm.common import checkpointed, partitions_of

POSITIVES, NEGATIVES = 5, 3
#: A negative's score, in hundredths of its positive's: least and most.
LEAST, MOST = 50, 95
#: Segments of a vector, level by level.
LEVELS = (1, 4, 16)
#: Components of a part's rows: what a task holds of them in doubles, and half as much again in summaries.
CELLS = 1 << 22


def summaries(matrix: np.ndarray, levels: tuple[int, ...] = LEVELS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level the segments' means, times the root of their length, and their deviations; a row per vector."""
    out = []
    for count in levels:
        cuts = np.unique(np.linspace(0, matrix.shape[1], count + 1).astype(int))
        sizes = np.diff(cuts)
        means = np.add.reduceat(matrix, cuts[:-1], axis=1) / sizes
        rest = matrix - np.repeat(means, sizes, axis=1)
        out.append((means * np.sqrt(sizes), np.sqrt(np.add.reduceat(rest**2, cuts[:-1], axis=1))))
    return out


class Part:
    """Rows of one vector length, by label, with their summaries."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, labels: np.ndarray, matrix: np.ndarray):
        order = np.lexsort((copies, ids, labels))
        self.ids, self.copies, self.labels, self.exact = ids[order], copies[order], labels[order], matrix[order]
        self.matrix = self.exact.astype(float)
        self.levels = summaries(self.matrix)
        self.largest = int(np.abs(self.exact).max(initial=0))

    def bounds(self, level: int, rows: np.ndarray, anchor: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that the segments of a level leave possible; rounding errors allowed for."""
        means, deviations = self.levels[level]
        own_means, own_deviations = anchor[level]
        if 2 * len(rows) > len(self.ids):
            middle, radius = (means @ own_means)[rows], (deviations @ own_deviations)[rows]
        else:
            middle, radius = means[rows] @ own_means, deviations[rows] @ own_deviations
        radius = radius + 1e-9 * (1 + np.abs(middle) + radius)
        return middle - radius, middle + radius

    def scores(self, rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """Exact: in doubles where whole numbers of that size are exact, else in longs."""
        if len(vector) * self.largest * int(np.abs(vector).max(initial=0)) < 1 << 53:
            return (self.matrix[rows] @ vector.astype(float)).astype(np.int64)
        return self.exact[rows] @ vector

    def first(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the k highest scores, ties by id."""
        return np.lexsort((self.copies[rows], self.ids[rows], -scores))[:k]

    def same_label(self, label: int, own: int) -> np.ndarray:
        start, stop = np.searchsorted(self.labels, [label, label + 1])
        rows = np.arange(start, stop)
        return rows[self.ids[rows] != own]

    def other_label(self, label: int, own: int) -> np.ndarray:
        start, stop = np.searchsorted(self.labels, [label, label + 1])
        rows = np.concatenate([np.arange(start), np.arange(stop, len(self.ids))])
        return rows[self.ids[rows] != own]

    def best(self, rows: np.ndarray, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of highest score, and their scores."""
        anchor = [(m[0], d[0]) for m, d in summaries(vector[None].astype(float))]
        for level in range(len(LEVELS)):
            if len(rows) <= k:
                break
            low, high = self.bounds(level, rows, anchor)
            rows = rows[high >= np.partition(low, -k)[-k]]
        scores = self.scores(rows, vector)
        places = self.first(rows, scores, k)
        return rows[places], scores[places]

    def in_bands(self, rows: np.ndarray, vector: np.ndarray, bands: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each band (least and most score) the k rows of highest score in it, and their scores."""
        anchor = [(m[0], d[0]) for m, d in summaries(vector[None].astype(float))]
        for level in range(len(LEVELS)):
            low, high = self.bounds(level, rows, anchor)
            left = np.zeros(len(rows), dtype=bool)
            for least, most in bands.tolist():
                may = (high >= least) & (low <= most)
                sure = low[may & (low >= least) & (high <= most)]
                if len(sure) >= k:
                    may &= high >= np.partition(sure, -k)[-k]
                left |= may
            rows = rows[left]
        scores = self.scores(rows, vector)
        out = []
        for least, most in bands.tolist():
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            places = inside[self.first(rows[inside], scores[inside], k)]
            out.append((rows[places], scores[places]))
        return out


def _met(answer, names: list[str]):
    """Rows of each part are held, by vector length; then every anchor of the part gets its answer.

    answer: (Part, id, copy, label, vector, wanted) to lists, one per name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, ready = None, {}, {}
        for batch in batches:
            vectors = batch.column("vector")
            numbers = zip(*[batch.column(n).to_pylist() for n in ("part", "kind", "id", "copy", "label")])
            wanted = batch.column("wanted").to_pylist()
            out = [[] for _ in names]
            for place, (own_part, kind, row_id, copy, label) in enumerate(numbers):
                vector = vectors[place].values.to_numpy(zero_copy_only=False)
                if own_part != part:
                    part, held, ready = own_part, {}, {}
                if kind == 0:
                    held.setdefault(len(vector), []).append((row_id, copy, label, vector))
                    continue
                if len(vector) not in ready:
                    ids, copies, labels, matrix = zip(*held.pop(len(vector), [])) if held.get(len(vector)) else ([], [], [], [])
                    matrix = np.array(matrix, dtype=np.int64).reshape(len(ids), len(vector))
                    ready[len(vector)] = Part(np.array(ids, np.int64), np.array(copies, np.int64), np.array(labels, np.int64), matrix)
                for column, values in zip(out, answer(ready[len(vector)], row_id, copy, label, vector, wanted[place])):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    return run


def _positives(k: int):
    def answer(part: Part, own: int, copy: int, label: int, vector: np.ndarray, wanted: None):
        rows, scores = part.best(part.same_label(label, own), vector, k)
        n = len(rows)
        return [own] * n, [copy] * n, part.ids[rows].tolist(), part.copies[rows].tolist(), scores.tolist()

    return answer


def _negatives(k: int, least: int, most: int):
    def answer(part: Part, own: int, copy: int, label: int, vector: np.ndarray, wanted: list[int]):
        levels = sorted({s for s in wanted if s >= 0})
        bands = np.array([(-(-least * s // 100), most * s // 100) for s in levels], dtype=np.int64).reshape(-1, 2)
        found = part.in_bands(part.other_label(label, own), vector, bands, k) if levels else []
        out = ([], [], [], [], [], [])
        for level, (rows, scores) in zip(levels, found):
            n = len(rows)
            more = ([own] * n, [copy] * n, [level] * n, part.ids[rows].tolist(), part.copies[rows].tolist(), scores.tolist())
            for column, values in zip(out, more):
                column.extend(values)
        return out

    return answer


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    cells: int = CELLS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of each anchor's hard negatives.

    vectors and anchors: id, label (whole numbers) and vector (array<long>). An anchor's positives are its rows of highest
    score among those of its label; a positive's negatives are the rows of highest score among those of another label
    whose score is least to most hundredths of the positive's. cells: see CELLS.
    """

    def clean(df: DataFrame) -> DataFrame:
        whole = df.where("id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0")
        return whole.select("id", F.col("label").cast("long").alias("label"), "vector").distinct().withColumn("copy", F.xxhash64("label", "vector"))

    rows = checkpointed(clean(vectors))
    size = rows.agg(F.sum(F.size("vector"))).first()[0] or 0
    parts = max(partitions_of(vectors), math.ceil(size / cells))
    columns = ["part", "kind", "id", "copy", "label", "vector", "wanted"]
    dealt = rows.withColumns(
        {"part": F.pmod(F.xxhash64("id", "copy"), F.lit(parts)).cast("int"), "kind": F.lit(0), "wanted": F.lit(None).cast("array<long>")}
    ).select(*columns)

    def met(asked: DataFrame, answer, names: list[str]) -> DataFrame:
        everywhere = asked.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "kind": F.lit(1)}).select(*columns)
        both = dealt.unionByName(everywhere).repartitionByRange(parts, "part").sortWithinPartitions("part", "kind")
        return both.mapInArrow(_met(answer, names), ", ".join(f"{n} long" for n in names))

    asked = clean(anchors)
    key = ["anchor_id", "anchor_copy"]
    near = met(asked.withColumn("wanted", F.lit(None).cast("array<long>")), _positives(positives), [*key, "positive_id", "positive_copy", "positive_score"])
    place = Window.partitionBy(*key).orderBy(F.desc("positive_score"), "positive_id", "positive_copy")
    chosen = checkpointed(near.withColumn("place", F.row_number().over(place)).where(F.col("place") <= positives))
    wanted = chosen.groupBy(*key).agg(F.collect_set("positive_score").alias("wanted"))  # at most `positives` of an anchor
    banded = asked.join(wanted, (F.col("id") == F.col("anchor_id")) & (F.col("copy") == F.col("anchor_copy"))).select(*columns[2:])
    far = met(banded, _negatives(negatives, least, most), [*key, "positive_score", "negative_id", "negative_copy", "negative_score"])
    order = Window.partitionBy(*key, "positive_score").orderBy(F.desc("negative_score"), "negative_id", "negative_copy")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    found = chosen.join(ranked, [*key, "positive_score"])
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
