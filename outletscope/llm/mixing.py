"""Mixing to target weights with soft membership.

A softmax classifier learned from a labelled table gives every document a posterior over domains. A document's rate r
says how often it is read; the expected tokens of domain k are sum(r * tokens * posterior_k). Sought are the rates, not
below a floor, of least squared distance of the totals from the targets, by projected gradient: where distances between
rates are weighted by tokens, a step takes posterior . gap / L off a rate, L the largest eigenvalue of
sum(tokens * p p'), and cuts it at the floor. Steps are accelerated, and the acceleration begins anew where it leads
uphill. A rate follows from its posterior and the steps so far, so a step is one aggregation over token counts and
posteriors; only the totals, a number per domain, reach the driver. The steps end when the targets are met, or when a
lower bound of the distance (from the gap itself, by duality) shows that no rates come nearer.

Where posteriors are so soft, or the floor so binding, that this takes more than PASSES steps, Newton steps go on from the
start on the dual problem: rates of the form max(floor, start - p.push), one number of push for each domain, with a
small weight eps on the distance from the start that is lowered until the same measure holds.

Training: at most TRAIN_ROWS labelled documents of the table, chosen by a hash of their id, as BUCKETS + SHAPES numbers each.

Cases: a null or empty text has no tokens, the posterior of an empty text, and a rate like any other. A domain nobody
belongs to can't reach its target; the nearest totals are found. Unlabelled documents and labels without a document
teach nothing, null ids and null domains neither; of several labels of an id the largest counts. Without training
rows every posterior is even. Rows that repeat an id get the same share of luck. An empty table gives an empty
result. Other columns are passed through unread.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from outletscope.llm.common import checkpointed, present, sampled, slices
from outletscope.llm.ngrams import ngram_rows

TRAIN_ROWS = 4_000
ORDER, BITS = 2, 9
BUCKETS, SHAPES = 1 << BITS, 5
#: Steps of projected gradient, then of Newton; the gap that counts as none.
PASSES, STEPS, TOLERANCE = 40, 100, 1e-4
#: Lengths of a step that are tried at once; the weight of the distance from the start at first, its divisor, its least.
LENGTHS = 8.0 ** -np.arange(8)
EPS, LOWER, LEAST_EPS = 1e-2, 100.0, 1e-14
#: Characters handled at once.
AT_ONCE = 1 << 19


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: root frequencies of hashed character pairs and some shapes; and the number of its tokens (words)."""
    out = np.zeros((len(texts), BUCKETS + SHAPES), dtype=np.float32)
    tokens = np.zeros(len(texts), dtype=np.int64)
    for buckets, starts, counted in ngram_rows(texts, (ORDER,), BITS, False):
        row = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(buckets))))
        counts = np.bincount(row[counted] * BUCKETS + buckets[counted], minlength=len(texts) * BUCKETS).reshape(len(texts), -1)
        out[:, :BUCKETS] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    for i, text in enumerate(texts):
        words = text.split()
        tokens[i] = n = len(words)
        signs = sum(map(text.count, "|.,;:!?"))
        upper = sum(map(str.isupper, words))
        out[i, BUCKETS:] = (1, len(set(words)) / max(n, 1), np.log1p(n) / 10, signs / max(n, 1), upper / max(n, 1))
    return out, tokens


@dataclass
class Classifier:
    """Softmax over domains."""

    domains: list[str]
    weights: np.ndarray

    def posteriors(self, rows: np.ndarray) -> np.ndarray:
        scores = rows @ self.weights
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)


def fitted(domains: list[str], rows: np.ndarray, labels: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> Classifier:
    """Softmax regression by accelerated gradient descent."""
    model = Classifier(domains, np.zeros((rows.shape[1], len(domains))))
    if not len(rows) or len(domains) < 2:
        return model
    truth = np.eye(len(domains))[labels]
    rate = 1.0 / (0.5 * float(np.mean((rows.astype(float) ** 2).sum(axis=1))) + ridge)
    ahead = model.weights
    for step in range(steps):
        model.weights, before = ahead, model.weights
        gradient = rows.T @ (model.posteriors(rows) - truth) / len(rows) + ridge * model.weights
        moved = model.weights - rate * gradient
        ahead = moved + step / (step + 3) * (moved - before)
        model.weights = moved
    return model


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], rows: int = TRAIN_ROWS) -> Classifier:
    """labelled: doc_id and domain. The classifier of the given domains."""
    marks = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(sampled(present(marks, docs), rows)), "doc_id")  # at most `rows` labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chars=AT_ONCE):
            found = features(batch.column("text").to_pylist())[0].astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.array([r.tobytes() for r in found], pa.binary())], ["domain", "row"])

    found = [(r.domain, r.row) for r in sample.mapInArrow(run, "domain string, row binary").toLocalIterator()]
    if not found:
        return Classifier(domains, np.zeros((BUCKETS + SHAPES, len(domains))))
    matrix = np.frombuffer(b"".join(bytes(r) for _, r in found), dtype=np.float16).reshape(len(found), -1).astype(np.float32)
    return fitted(domains, matrix, np.array([domains.index(d) for d, _ in found]))


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, text_key, tokens and p_0, p_1, ... (a column per domain) of every row."""
    names = [f"p_{i}" for i in range(len(model.domains))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chars=AT_ONCE):
            rows, tokens = features([t or "" for t in batch.column("text").to_pylist()])
            found = model.posteriors(rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(tokens), *map(pa.array, found.T.copy())], ["doc_id", "text_key", "tokens", *names])

    text = F.col("text").cast("string")
    read = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    return read.mapInArrow(run, "doc_id long, text_key long, tokens long, " + ", ".join(f"{n} double" for n in names))


def dotted(columns: list[str], values: list[float]) -> Column:
    out = F.lit(0.0)
    for column, value in zip(columns, values):
        out = out + F.col(column) * F.lit(float(value))
    return out


@dataclass
class Descent:
    """Accelerated projected-gradient steps: what each takes off a posterior's rate, and its momentum."""

    floor: float
    start: float
    steps: list[tuple[np.ndarray, float]]

    def rates(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of posteriors: the rates, those of the step before, and the point the last step went out from."""
        now = before = ahead = point = np.full(len(p), self.start)
        for push, momentum in self.steps:
            point, before, now = ahead, now, np.maximum(self.floor, ahead - p @ push)
            ahead = now + momentum * (now - before)
        return now, before, point

    def measured(self, members: DataFrame, names: list[str], wanted: float, gap: np.ndarray) -> tuple[np.ndarray, float, float, np.ndarray]:
        """The domain totals in units of wanted; how far the last step led uphill; the least product of a posterior with
        gap; and sum(tokens * p p')."""
        k = len(names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, least = np.zeros(k + 1 + k * k), np.inf
            for batch in batches:
                tokens, p = _told(batch, names, wanted)
                if not len(tokens):
                    continue
                now, before, point = self.rates(p)
                sums[:k] += (tokens * now) @ p
                sums[k] += tokens @ ((point - now) * (now - before))
                sums[k + 1 :] += ((p * tokens[:, None]).T @ p).ravel()
                least = min(least, float((p @ gap).min()))
            values = np.append(sums, least)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["place", "value"])

        out = _gathered(members.select("tokens", *names).mapInArrow(run, "place long, value double"), 1, k + 2 + k * k)[0]
        return out[:k], float(out[k]), float(out[-1]), out[k + 1 : -1].reshape(k, k)

    def applied(self, members: DataFrame, names: list[str]) -> DataFrame:
        """members with their rate."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(self.rates(p)[0])], [*batch.schema.names, "rate"])

        return members.mapInArrow(run, StructType([*members.schema.fields, StructField("rate", DoubleType())]))


def _told(batch: pa.RecordBatch, names: list[str], wanted: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, in units of wanted, and posteriors of the rows that have tokens."""
    tokens = batch.column("tokens").to_numpy(zero_copy_only=False).astype(float) / wanted
    p = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
    return tokens[tokens > 0], p[tokens > 0]


def _gathered(parts: DataFrame, n: int, width: int) -> np.ndarray:
    """Values by place, n rows of so many: sums, and the least in the last column."""
    out = np.zeros((n, width))
    for row in parts.groupBy("place").agg(F.sum("value").alias("total"), F.min("value").alias("least")).collect():  # n * width rows
        i, j = divmod(row.place, width)
        out[i, j] = row.total if j < width - 1 else row.least
    out[np.isinf(out)] = 0
    return out


def rates(
    members: DataFrame, targets: list[float], floor: float = 0.0, passes: int = PASSES, steps: int = STEPS, tolerance: float = TOLERANCE
) -> DataFrame:
    """members (tokens and p_0, p_1, ..., which sum to 1) with rate, at least floor, of the domain totals nearest the targets.

    Ends when no total is off by more than tolerance of all tokens wanted, or when the totals' distance from the targets
    is within that of the least that rates of at least floor can reach. Warns if neither is so after the given steps.
    """
    if floor < 0:
        raise ValueError("rates are nonnegative")
    names = [f"p_{i}" for i in range(len(targets))]
    wanted = max(float(sum(targets)), 1e-12)
    goal = np.array(targets, dtype=float) / wanted
    found = Descent(floor, max(1.0, floor), [])
    totals, _, _, metric = found.measured(members, names, wanted, np.zeros(len(names)))
    largest = max(float(np.linalg.eigvalsh(metric)[-1]), 1e-300) if len(names) else 1.0
    have, weight, bound, ahead = totals / found.start, 1.0, 0.0, totals
    for _ in range(passes):
        if np.abs(totals - goal).max(initial=0) <= tolerance:
            return found.applied(members, names)
        gap = totals - goal
        found.steps.append(((ahead - goal) / largest, 0.0))
        before, (totals, uphill, low, _) = totals, found.measured(members, names, wanted, gap)
        # no posterior's product with v is negative, so rates of at least floor leave at least this distance
        v = gap + max(0.0, -low)
        bound = max(bound, float((floor * have - goal) @ v) / max(float(np.linalg.norm(v)), 1e-300))
        if np.linalg.norm(gap) - bound <= tolerance:
            found.steps.pop()
            return found.applied(members, names)
        weight = 1.0 if uphill > 0 else weight
        following = (1 + (1 + 4 * weight * weight) ** 0.5) / 2
        momentum, weight = (weight - 1) / following, following
        found.steps[-1] = (found.steps[-1][0], momentum)
        ahead = totals + momentum * (totals - before)
    return _newton(members, targets, floor, steps, tolerance)


def _newton(members: DataFrame, targets: list[float], floor: float, steps: int, tolerance: float) -> DataFrame:
    """The same by Newton steps on the dual problem."""
    names = [f"p_{i}" for i in range(len(targets))]
    wanted = max(float(sum(targets)), 1e-12)
    goal = np.array(targets, dtype=float) / wanted
    start = max(1.0, floor)
    push, eps, bound = np.zeros(len(names)), EPS, 0.0
    (totals, value, low, free), *_ = _states(members, names, push[None], floor, start, wanted)
    have = totals / start
    for _ in range(steps):
        gaps = totals - goal
        off = float(np.linalg.norm(gaps))
        # rates of at least floor leave at least this distance, for every v that no posterior's product with is negative
        v = eps * (push + max(0.0, -low))
        bound = max(bound, max(0.0, 2 * float(floor * have @ v - goal @ v - v @ v / 2)) ** 0.5)
        if np.abs(gaps).max() <= tolerance or off - bound <= tolerance:
            break
        while np.linalg.norm(eps * push - gaps) <= 0.3 * eps * np.linalg.norm(push) and eps > LEAST_EPS:
            eps /= LOWER
        move = np.linalg.solve(free + eps * np.eye(len(names)), gaps - eps * push)
        trials = push + LENGTHS[:, None] * move
        found = _states(members, names, trials, floor, start, wanted)
        dual = [s[1] + goal @ t + eps * (t @ t) / 2 for s, t in zip(found, trials)]
        best = int(np.argmin(dual))
        if dual[best] < value + goal @ push + eps * (push @ push) / 2:
            push, (totals, value, low, free) = trials[best], found[best]
        elif eps > LEAST_EPS:
            eps /= LOWER
        else:
            warnings.warn(_short_of(off, bound), stacklevel=2)
            break
    else:
        warnings.warn(_short_of(float(np.linalg.norm(totals - goal)), bound), stacklevel=2)
    return members.withColumn("rate", F.greatest(F.lit(float(floor)), F.lit(start) - dotted(names, push.tolist())))


def _short_of(off: float, bound: float) -> str:
    return f"domain totals are {off:.3g} of the tokens wanted off their targets; the least distance is only known to be {bound:.3g} or more"


def _states(members: DataFrame, names: list[str], pushes: np.ndarray, floor: float, start: float, wanted: float) -> list[tuple]:
    """For each push, in units of wanted: the domain totals, the documents' part of the dual value, the least product with
    a posterior, and M = sum(tokens * p p') over the documents whose rates are above the floor."""
    n, k = pushes.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, least = np.zeros((n, k + 1 + k * k)), np.full(n, np.inf)
        for batch in batches:
            tokens, p = _told(batch, names, wanted)
            if not len(tokens):
                continue
            product = p @ pushes.T
            plain = start - product
            rate = np.maximum(floor, plain)
            least = np.minimum(least, product.min(axis=0))
            sums[:, :k] += (tokens[:, None] * rate).T @ p
            sums[:, k] += tokens @ (rate * plain - rate * rate / 2)
            for i in range(n):
                free = plain[:, i] > floor
                sums[i, k + 1 :] += ((p[free] * tokens[free, None]).T @ p[free]).ravel()
        values = np.column_stack([sums, least]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["place", "value"])

    parts = members.select("tokens", *names).mapInArrow(run, "place long, value double")
    out = _gathered(parts, n, k + 2 + k * k)
    return [(r[:k], r[k], r[-1], r[k + 1 : -1].reshape(k, k)) for r in out]


def copies(rate: Column, doc_id: Column) -> Column:
    """A whole number of readings whose mean is the rate: the fraction is rounded up by a hash of the id."""
    luck = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("mix")), 11) / F.lit(float(1 << 53))
    whole = F.floor(rate)
    return (whole + F.when(luck < rate - whole, 1).otherwise(0)).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], floor: float = 0.0, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text_key (a hash of the text), tokens, p_0, p_1, ... (domains in the order of weights), rate and copies of
    every row.

    The targets share out the fewest tokens, at least the table's own, that let no domain's target fall below floor
    times its present tokens.
    """
    domains = list(weights)
    shares = np.array(list(weights.values()), dtype=float)
    if not len(shares) or (shares < 0).any() or not shares.sum():
        raise ValueError("weights must be nonnegative, and one of them positive")
    shares /= shares.sum()
    members = checkpointed(posteriors(docs, train(docs, labelled, domains, rows)))
    names = [f"p_{i}" for i in range(len(domains))]
    have = [x or 0.0 for x in members.agg(*(F.sum(F.col("tokens") * F.col(n)) for n in names)).first()]
    budget = max([sum(have), *(floor * h / s for h, s in zip(have, shares) if s)])
    found = rates(members, (shares * budget).tolist(), floor)
    return found.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))
