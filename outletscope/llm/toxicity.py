"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

A text is folded first: compatibility forms, accents-free look-alikes of other scripts and digits standing for letters
become plain letters, everything else that is not a letter a space. Terms are beginnings of words or whole words; a
term's weight is the log odds of toxic documents over others. Matches inside an exception phrase don't count. The
weights found, and the same per 100 words, go through a logistic curve.

Training: the terms, exceptions and the curve are learned from at most TRAIN_ROWS labelled documents, chosen by a hash
of their id, and all bounded by parameters; scoring reads the text only. Near copies of a document of the same side, told
by most of SKETCH independent hashes agreeing with that one document, count once as evidence for terms and exceptions;
the curve is fitted on the sample as it is.

Cases: a null or empty text scores as a text without a match. Nothing learned (empty tables, no labels, one class
only) gives a score of 0 to every row. Null ids and null labels teach nothing; of repeated labels the highest counts.
Ties between terms are broken by length, then alphabet. Other columns are passed through unread.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletscope.llm.common import checkpointed, column_of, held_out, packed_rows, present, row_schema, sampled, slices

THRESHOLD = 0.3
TRAIN_ROWS = 15_000
SHORTEST, LONGEST = 4, 10
#: Least documents of a term or exception, a term's least log odds, terms that explain a toxic document.
SUPPORT, LEAST_WEIGHT, EXPLAIN = 3, 1.2, 12
#: Least log likelihood ratio of an exception phrase.
EXCEPTION_EVIDENCE = 10.0
#: Hashes of a document that tell copies, how many of them two copies share at least, and hashes looked up together.
SKETCH, SHARED, BAND = 64, 45, 3

# Characters of other scripts, digits and signs, and the letter each is read as.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁӏԛԝвнкмтαβεικνορτυχη" "0134578$@!|€£",
        "aeopcyxijsdlqwbhkmtabeiknoptuxn" "oieastbsailel",
    )
)
PLAIN = str.maketrans({**LOOKALIKES, **{k.upper(): v for k, v in LOOKALIKES.items() if k.isalpha()}})
SIGNS = frozenset("0134578$@!|€£")
ODD_FACTOR = np.uint64(0x9E3779B97F4A7C15)
SEEDS = np.random.default_rng(42).integers(0, 1 << 64, SKETCH, dtype=np.uint64)


NOT_LETTERS = re.compile(r"[\W\d_]+")


def folded(text: str | None) -> str:
    """Lower-case letters and single spaces, one before each word and one at the end.

    A digit or sign is read as a letter only in a word that has letters: "1d10t" is folded, "2024" is not. An accent on
    a letter stays, since it tells words of a language apart.
    """
    low = (text or "").lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKC", low)
    words = []
    for word in low.split():
        if not word.isalpha() or not word.isascii():
            if not SIGNS.isdisjoint(word):
                core = word.rstrip("!|.,;:?")
                word = core.translate(PLAIN) if any(map(str.isalpha, core)) else ""
            elif not word.isascii():
                word = word.translate(PLAIN)
            if not word.isalpha():
                word = NOT_LETTERS.sub(" ", word)
        words.append(word)
    return " " + " ".join(" ".join(words).split()) + " "


def candidates(text: str) -> set[str]:
    """Beginnings of the folded text's words, and its whole words, as patterns with their leading space."""
    out = set()
    for word in set(text.split()):
        out.update([f" {word[:n]}" for n in range(SHORTEST, min(len(word), LONGEST) + 1)])
        if 3 <= len(word) <= 2 * LONGEST:
            out.add(f" {word} ")
    return out


@dataclass
class Lexicon:
    """Terms with their weights, exception phrases (longer patterns that hold a term) and the curve."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    trained: bool = False

    def __post_init__(self) -> None:
        self.automaton = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "automaton": None}

    def matches(self, text: str) -> list[tuple[int, str]]:
        """Ends and terms of the matches outside exception phrases; of nested terms of a word the longest counts."""
        if not self.terms:
            return []
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for pattern in [*self.terms, *self.exceptions]:
                self.automaton.add_word(pattern, pattern)
            self.automaton.make_automaton()
        found = list(self.automaton.iter(text))
        shielded = [(end - len(p) + 1, end) for end, p in found if p in self.exceptions]
        longest: dict[int, tuple[int, str]] = {}
        for end, pattern in found:
            start = end - len(pattern) + 1
            if pattern in self.terms and not any(a <= start and end <= b for a, b in shielded):
                longest[start] = max(longest.get(start, (0, "")), (end, pattern))
        return list(longest.values())

    def features(self, text: str | None) -> tuple[float, float]:
        """Log of the weights found, and of the same per 100 words."""
        plain = folded(text)
        total = sum(self.terms[p] for _, p in self.matches(plain))
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, plain.count(" ") - 1)))

    def score(self, text: str | None) -> float:
        if not self.trained:
            return 0.0
        a, b = self.features(text)
        bias, by_total, by_density = self.curve
        return float(1 / (1 + np.exp(-(bias + by_total * a + by_density * b))))


def _documents(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text and toxic of a bounded sample of the labelled documents that docs has."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    read = docs.where("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"))
    return read.join(F.broadcast(sampled(present(marks, docs), rows)), "doc_id")  # at most `rows` labels


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other documents of the partition each candidate occurs."""
    found: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in slices(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            found[toxic <= 0].update(candidates(folded(text)))
        if sum(map(len, found)) > 500_000:
            yield _pairs(*found)
            found = (Counter(), Counter())
    yield _pairs(*found)


def _pairs(toxic: Counter, other: Counter) -> pa.RecordBatch:
    terms, none = [*toxic, *other], [0]
    counts = [[*toxic.values(), *none * len(other)], [*none * len(toxic), *other.values()]]
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], ["term", "toxic", "other"])


def _telling(rows: DataFrame, sizes: list[int]) -> tuple[dict[str, tuple[int, int]], int]:
    """Documents that hold each term (toxic, other) whose evidence is enough, and the number of terms it was chosen from.

    Evidence only shrinks while terms are chosen, so no other term could get in.
    """
    counted = rows.mapInArrow(_counts, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    weight = F.log((F.col("toxic") + 0.5) / (sizes[0] + 1)) - F.log((F.col("other") + 0.5) / (sizes[1] + 1))
    known = checkpointed(counted.where((F.col("toxic") >= SUPPORT) & (weight >= LEAST_WEIGHT)))
    number, chance = known.count(), sizes[0] / sum(sizes)
    n = F.col("toxic") + F.col("other")
    share = F.col("toxic") / n
    evidence = n * (share * F.log(share / chance) + (1 - share) * F.log(F.greatest(1 - share, F.lit(1e-12)) / (1 - chance)))
    # logarithms may differ in the last digits; _chosen decides
    strong = known.where((share > chance) & (evidence >= _bound(number) - 1e-6))
    return {r.term: (r.toxic, r.other) for r in strong.collect()}, number


def _sketch(text: str | None) -> bytes:
    """Least hashes of the text's pairs of neighbouring words, each under a hash function of its own."""
    words = (text or "").lower().split()
    found = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in words] or [0], dtype=np.uint64)
    pairs = np.unique(found[:-1] * ODD_FACTOR + found[1:] if len(found) > 1 else found)
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(pairs), 1 << 13):
        mixed = (pairs[at : at + (1 << 13), None] ^ SEEDS) * ODD_FACTOR
        mixed = (mixed ^ (mixed >> np.uint64(32))) * ODD_FACTOR
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).tobytes()


def _copies(sketches: list[bytes]) -> list[int]:
    """Places of the documents that share SHARED hashes or more with one and the same document kept before.

    Two such documents differ in fewer hashes than there are bands, so they agree on a whole band and are compared.
    """
    rows = np.frombuffer(b"".join(sketches), dtype=np.uint32).reshape(-1, SKETCH)
    kept: dict[tuple[int, bytes], list[int]] = {}
    out = []
    for i, row in enumerate(rows):
        bands = [(k, row[k : k + BAND].tobytes()) for k in range(0, SKETCH - BAND + 1, BAND)]
        near = sorted({j for band in bands for j in kept.get(band, ())})
        if near and ((rows[near] == row).sum(axis=1) >= SHARED).any():
            out.append(i)
            continue
        for band in bands:
            kept.setdefault(band, []).append(i)
    return out


def _unlike(sample: DataFrame) -> tuple[DataFrame, list[int]]:
    """The sample without documents that are copies of another of their side, and how many toxic and other ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sketches = pa.array([_sketch(t) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("toxic", "doc_id", "place")), sketches], ["toxic", "doc_id", "place", "sketch"])

    read = sample.select("text", (F.col("toxic") > 0).alias("toxic"), F.col("doc_id").cast("string").alias("doc_id"), "place")
    found = read.mapInArrow(run, "toxic boolean, doc_id string, place long, sketch binary").toLocalIterator()  # bounded by `rows`
    rows = sorted((not r.toxic, r.doc_id, bytes(r.sketch), r.place) for r in found)
    sizes, gone = [], []
    for side in (False, True):
        own = [r for r in rows if r[0] == side]
        copies = _copies([r[2] for r in own])
        gone += [(own[i][3],) for i in copies]
        sizes.append(len(own) - len(copies))
    if not gone:
        return sample, sizes
    left_out = sample.sparkSession.createDataFrame(gone, "place long")
    return sample.join(F.broadcast(left_out), "place", "left_anti"), sizes  # bounded by `rows`


def _evidence(toxic: int, other: int, chance: float) -> float:
    """Log likelihood ratio of the toxic share among the documents that hold a term against the share among all."""
    n = toxic + other
    share = toxic / n if n else 0.0
    if share <= chance:
        return 0.0
    return n * (share * math.log(share / chance) + (1 - share) * math.log(max(1 - share, 1e-12) / (1 - chance)))


def _bound(number: int) -> float:
    """More evidence than the best of so many terms reaches by chance."""
    return math.log(max(1, number)) + 3


def _nested(a: str, b: str) -> bool:
    """Whether one pattern is the beginning of the other."""
    return a.startswith(b.rstrip()) or b.startswith(a.rstrip())


def _chosen(weights: dict[str, float], other: dict[str, int], rows: list[list[str]], n_other: int, number: int) -> list[str]:
    """Terms that explain the toxic documents (rows, as their terms), the strongest evidence first.

    A document is explained by EXPLAIN terms and gives no evidence for more: words that only go along with others do
    not get in. The evidence must exceed what the best of number terms reaches by chance. Of terms of a word that
    explain about as much, the longest is the most specific; another term of that word must weigh more to get in.
    """
    chance = len(rows) / (len(rows) + n_other)
    holds: dict[str, set[int]] = {t: set() for t in other}
    for i, own in enumerate(rows):
        for term in own:
            holds[term].add(i)
    bound = _bound(number)
    missing = [EXPLAIN] * len(rows)
    out: list[str] = []
    while holds:
        found = {t: _evidence(len(s), other[t], chance) for t, s in holds.items()}
        best = max(found, key=lambda t: (found[t], t))
        if found[best] < bound:
            break
        alike = [t for t in holds if t.startswith(best.rstrip()) and len(holds[t]) >= 0.97 * len(holds[best]) and found[t] >= bound]
        pick = max([best, *alike], key=lambda t: (len(t.strip()), t))
        out.append(pick)
        for i in holds.pop(pick):
            missing[i] -= 1
        open_terms = (t for t in holds if not _nested(t, pick) or weights[t] > weights[pick] + 0.5)
        holds = {t: kept for t in open_terms if (kept := {i for i in holds[t] if missing[i] > 0})}
    return out


def _curve(features: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the labels on the features, by Newton steps with a light ridge."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2]) * len(x) ** 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, exceptions: frozenset[str] = frozenset()) -> Lexicon:
    """The lexicon from docs (text) and labels (toxic); exceptions: further phrases, folded, that shield a term."""
    sample = checkpointed(_documents(docs, labels, rows).withColumn("place", F.monotonically_increasing_id()))
    unlike, sizes = _unlike(sample)
    if not all(sizes):
        return Lexicon()
    toxic_rows, other_rows = unlike.where("toxic > 0"), unlike.where("toxic <= 0")
    counts, number = _telling(unlike, sizes)
    weights = {t: float(np.log((a + 0.5) / (sizes[0] + 1)) - np.log((b + 0.5) / (sizes[1] + 1))) for t, (a, b) in counts.items()}
    known = frozenset(counts)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [sorted(candidates(folded(t)) & known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string()))], ["terms"])

    own_terms = [r.terms for r in toxic_rows.mapInArrow(held, "terms array<string>").toLocalIterator()]  # bounded by `rows`
    chosen = _chosen(weights, {t: b for t, (_, b) in counts.items()}, own_terms, sizes[1], number)
    lexicon = Lexicon({t: weights[t] for t in chosen}, exceptions, trained=True)
    shares = {t: counts[t][0] / (sum(counts[t]) + 1) for t in chosen}
    # a phrase must be in none of the toxic documents, copies among them
    lexicon.exceptions |= _exceptions(sample.where("toxic > 0").unionByName(other_rows), lexicon, shares)
    return _fitted(sample, lexicon)


def phrases(lexicon: Lexicon, text: str) -> set[str]:
    """Each matched word with the word before and with the word behind it."""
    out = set()
    for end, pattern in lexicon.matches(text):
        start = end - len(pattern) + 1
        stop = text.index(" ", start + 1)
        before = text.rfind(" ", 0, start)
        behind = text.find(" ", stop + 1)
        if before >= 0:
            out.add(text[before : stop + 1])
        if behind >= 0:
            out.add(text[start : behind + 1])
    return out


def _exceptions(sample: DataFrame, lexicon: Lexicon, shares: dict[str, float]) -> frozenset[str]:
    """Phrases around a term that occur in documents that are not toxic and in none that is, in more than chance gives.

    shares: the toxic share of the documents that hold a term.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = [
                (phrase, int(toxic > 0))
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist())
                for phrase in phrases(lexicon, folded(text))
            ]
            held = {p: max((share for term, share in shares.items() if term in p), default=0.0) for p in {p for p, _ in pairs}}
            columns = [
                pa.array([p for p, _ in pairs], pa.string()),
                pa.array([t for _, t in pairs], pa.int64()),
                pa.array([held[p] for p, _ in pairs], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["phrase", "toxic", "share"])

    counted = sample.mapInArrow(found, "phrase string, toxic long, share double").groupBy("phrase").agg(
        F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("other"), F.max("share").alias("share")
    )
    telling = F.col("other") * -F.log1p(-F.col("share")) >= EXCEPTION_EVIDENCE
    rows = counted.where((F.col("toxic") == 0) & (F.col("other") >= SUPPORT) & telling).select("phrase")
    return frozenset(r.phrase for r in rows.collect())  # phrases of the bounded sample, by their evidence


def _fitted(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.array([lexicon.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            toxic = np.array([float(t > 0) for t in batch.column("toxic").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(toxic)], ["a", "b", "toxic"])

    # documents without a match are all the same point
    points = sample.mapInArrow(measured, "a double, b double, toxic double").collect()  # two numbers for each of `rows`
    x = np.array([(r.a, r.b) for r in points]).reshape(-1, 2)
    lexicon.curve = _curve(x, np.array([r.toxic for r in points]))
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs, or the columns to keep, as struct `row`, with its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [lexicon.score(t) for t in column_of(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], ["row", "score"])

    rows = packed_rows(docs, keep)
    return rows.mapInArrow(run, row_schema(rows, "score double"))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs, or the columns to keep (doc_id among them), as struct `row`, with score and held_out.

    Learned from the labelled rows that are not held out.
    """
    lexicon = learn(docs.where(~held_out()), labels, rows)
    return scored(docs, lexicon, keep).withColumn("held_out", held_out("row.doc_id"))
