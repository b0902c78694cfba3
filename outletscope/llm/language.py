"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit of the code a binary classifier over hashed character n-grams tells the
languages with a one from those with a zero: log odds of the n-gram between the two sides, averaged over the text. The
codeword nearest to the margins wins, each bit's logistic loss weighted by how well its classifier does on the
training rows. Two codewords about equally near flag the text as ambiguous.

Training: n-gram counts per language of at most TRAIN_ROWS labelled documents, chosen by a hash of their id; the
counts, languages x 2**BITS numbers, are the model. Prediction reads the text only.

Cases: a null text, or one without a letter, is "und" with score 0. So is every text if nothing was learned (an empty
table, no labels). With one learned language every other text has it, with score 1. Null ids and null languages teach
nothing; repeated rows count as often as they occur. A very long text is read whole, in stretches, so that it takes little
more memory than it has itself. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletscope.llm.common import checkpointed, held_out, sampled, slices
from outletscope.llm.ngrams import ngram_rows, ngram_stretches

UNKNOWN = "und"
TRAIN_ROWS = 20_000
ORDERS, BITS = (2, 3), 14
SMOOTHING = 0.5
#: Characters handled at once; a longer text is added up by stretches of so many.
AT_ONCE = 1 << 19
#: Loss by which the second codeword must be farther, per unit of weight.
MARGIN = 0.05
#: Up to so many languages every split of them into two sides is a bit.
EXHAUSTIVE = 7


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 per language.

    Few languages have the exhaustive code: every split into two sides is a bit. More have 15 bits per doubling of
    their number, columns of a fixed pseudo-random matrix that differ from each other and their opposites.
    """
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= EXHAUSTIVE:
        rest = [r for r in product((1, -1), repeat=languages - 1) if -1 in r]
        return np.array([(1, *r) for r in rest], dtype=float).T
    width = 15 * int(np.ceil(np.log2(languages)))
    draws = np.random.default_rng(languages)
    columns: dict[bytes, np.ndarray] = {}
    while len(columns) < width:
        column = draws.choice([1.0, -1.0], languages)
        if abs(column.sum()) < languages:  # at least 2**7 - 1 such columns, more than width
            columns.setdefault((column * column[0]).tobytes(), column)
    return np.stack(list(columns.values()), axis=1)


class Model:
    """Weights of the binary classifiers, their codewords and their trust."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: language x order x bucket."""
        self.languages = languages
        self.codes = codewords(len(languages))
        shares = []
        for bit in self.codes.T:
            one, zero = (counts[bit == side].sum(axis=0) + SMOOTHING for side in (1, -1))
            shares.append(np.log(one / one.sum(axis=1, keepdims=True)) - np.log(zero / zero.sum(axis=1, keepdims=True)))
        self.weights = np.stack(shares, axis=-1).astype(np.float32) if shares else np.zeros((*counts.shape[1:], 0), np.float32)
        self.trust = np.ones(self.codes.shape[1])

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean log odds per text and bit."""
        total, n = np.zeros((len(texts), self.codes.shape[1])), np.zeros(len(texts))
        long = np.array([len(t) > AT_ONCE for t in texts], dtype=bool)
        total[~long], n[~long] = self._sums([t for t, is_long in zip(texts, long) if not is_long])
        for i in np.flatnonzero(long):
            for found in ngram_stretches(texts[i], ORDERS, BITS, True, AT_ONCE):
                for weights, (buckets, counted) in zip(self.weights, found):
                    total[i] += weights[buckets[counted]].sum(axis=0, dtype=np.float64)
                    n[i] += counted.sum()
        return total / np.maximum(n, 1)[:, None]

    def _sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log odds per text and bit, added up, and the n-grams that count; all texts at once."""
        total = np.zeros((len(texts), self.codes.shape[1]), dtype=np.float64)
        n = np.zeros(len(texts))
        if not texts:
            return total, n
        for weights, (buckets, bounds, counted) in zip(self.weights, ngram_rows(texts, ORDERS, BITS, True)):
            scores = weights[buckets] * counted[:, None]
            sums = np.add.reduceat(np.concatenate([scores, np.zeros((1, scores.shape[1]), np.float32)]), bounds, axis=0, dtype=np.float64)
            total += sums
            n += np.add.reduceat(np.append(counted, False).astype(np.int64), bounds)
        return total, n

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted loss of each language's codeword."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None])
        return loss @ (self.trust / max(self.trust.sum(), 1e-12))

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers, scores, and whether the second codeword is about as near."""
        if len(self.languages) == 1:
            return np.zeros(len(texts), int), np.ones(len(texts)), np.zeros(len(texts), bool)
        losses = self.losses(self.margins(texts))
        order = np.argsort(losses, axis=1, kind="stable")
        near = np.take_along_axis(losses, order[:, :2], axis=1)
        likely = np.exp(-8 * (losses - near[:, :1]))
        return order[:, 0], 1 / likely.sum(axis=1), near[:, 1] - near[:, 0] < MARGIN


def _has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a partition, a row per language."""
    counts: dict[str, np.ndarray] = {}
    for batch in slices(batches, chars=AT_ONCE):
        by_language: dict[str, list[str]] = {}
        for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by_language.setdefault(language, []).append(text)
        for language, texts in by_language.items():
            held = counts.setdefault(language, np.zeros((len(ORDERS), 1 << BITS), np.int64))
            short = [t for t in texts if len(t) <= AT_ONCE]
            parts = [[(b, c) for b, _, c in ngram_rows(short, ORDERS, BITS, True)]] if short else []
            long = (part for t in texts if len(t) > AT_ONCE for part in ngram_stretches(t, ORDERS, BITS, True, AT_ONCE))
            for part in chain(parts, long):
                for i, (buckets, counted) in enumerate(part):
                    held[i] += np.bincount(buckets[counted], minlength=1 << BITS)
    yield pa.RecordBatch.from_pydict(
        {"lang": pa.array(list(counts), pa.string()), "counts": pa.array([c.tobytes() for c in counts.values()], pa.binary())}
    )


def _summed(pairs) -> dict[str, np.ndarray]:
    total: dict[str, np.ndarray] = {}
    for language, counts in pairs:
        row = np.frombuffer(counts, np.int64).reshape(len(ORDERS), -1)
        total[language] = total.get(language, 0) + row
    return total


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = _summed(pair for b in batches for pair in zip(b.column("lang").to_pylist(), b.column("counts").to_pylist()))
    yield pa.RecordBatch.from_pydict(
        {"lang": pa.array(list(total), pa.string()), "counts": pa.array([c.tobytes() for c in total.values()], pa.binary())}
    )


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """The model from text and lang of docs; None if there is no labelled text."""
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sample = checkpointed(sampled(labelled, rows))
    counts = sample.mapInArrow(_counted, "lang string, counts binary")
    merged = counts.repartition("lang").mapInArrow(_merged, "lang string, counts binary")
    total = _summed((r.lang, r.counts) for r in merged.toLocalIterator())
    total = {k: v for k, v in sorted(total.items()) if v.sum()}
    if not total:
        return None
    model = Model(list(total), np.stack(list(total.values())))
    if len(total) > 1:
        _set_trust(model, sample)
    return model


def _set_trust(model: Model, labelled: DataFrame) -> None:
    """Each bit's trust: the share of training rows on its right side, above chance."""
    number = {name: i for i, name in enumerate(model.languages)}

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hits = 0, np.zeros(model.codes.shape[1])
        for batch in slices(batches, chars=AT_ONCE):
            rows = [(number[x], t) for x, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()) if x in number]
            if rows:
                sides = model.codes[[i for i, _ in rows]]
                hits += (model.margins([t for _, t in rows]) * sides > 0).sum(axis=0)
                n += len(rows)
        yield pa.RecordBatch.from_pydict({"n": [n], "hits": pa.array([hits.tolist()], pa.list_(pa.float64()))})

    sums = labelled.mapInArrow(right, "n long, hits array<double>").agg(
        F.sum("n"), *(F.sum(F.col("hits")[i]) for i in range(model.codes.shape[1]))
    )
    n, *hits = sums.first()
    model.trust = np.maximum(np.array(hits) / max(n, 1) - 0.5, 0.01)


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chars=AT_ONCE):
            texts = batch.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if model is not None and _has_letter(t)]
            names, scores, flags = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if known:
                picks, scores[known], flags[known] = model.predict([texts[i] for i in known])
                for i, pick in zip(known, picks):
                    names[i] = model.languages[pick]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores), pa.array(flags)],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def language_of(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The language of every row, learned from the rows that are not held out; held_out says which are."""
    model = train(docs.where(~held_out()), rows)
    return identified(docs, model).withColumn("held_out", held_out())
