"""Periodic runs: stretches of words that repeat themselves, by a sparse table of match lengths, lag by lag.

The diagonal of a lag holds, for each word, how many words up to it equal the word a lag earlier. A run of period q shows
on the diagonal q as a stretch of matches of at least max(q, 12 - q), so it is enough to look at every such many-th
word: where that word occurred a lag earlier, the stretch of matches around it is followed to both ends, and when it ends
long enough its run is emitted at once. Lags rise, so the smallest period is found first; multiples of a run's period
match all through the run and are passed over there. By the look at every c-th word only, a text of n words costs
n * ln(n) looks and not the square of how often its words occur.

Texts of a batch lie one after the other, the longest first, with a stop between them that equals nothing, so one look
serves all texts that are long enough for a lag.

Cases: null, empty and blank texts have no words and no runs. Repeated rows are rows of their own, null ids are rows like
others. Ties: runs are ordered by start, then period. An empty table gives an empty result. Other columns are passed
through unread, or left away (`keep`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from outletscope.llm.common import column_of, packed_rows, row_schema, slices

#: Least words of a run, and how often it repeats its period at least.
LEAST_WORDS, LEAST_TIMES = 12, 2
#: Bytes of a text that are split into words at once; cells compared at once.
STRETCH, CELLS = 1 << 22, 1 << 20
#: Matches on one side of a word without which no stretch around it can be long enough: half of the fewest, six.
NEAR = np.arange(1, 4)

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
BLANKS = b" \t\n\x0b\x0c\r"


def words_of(data: bytes, size: int = STRETCH) -> Iterator[list[bytes]]:
    """The words of a text, stretch by stretch; no word is cut."""
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data) and data[end] not in BLANKS:
            end += 1
        yield data[start:end].split()
        start = end


def matched(words: np.ndarray, at: np.ndarray, lag: int, step: int, most: int) -> np.ndarray:
    """How many words in a row, behind (step 1) or before (step -1) each place, equal the word a lag earlier; at most `most`."""
    last = len(words) - 1
    out = np.zeros(len(at), dtype=np.int64)
    open_, width = np.arange(len(at)), min(8, most)
    while len(open_) and width:
        rest = []
        parts = -(-len(open_) * width // CELLS)
        for part in [open_] if parts == 1 else np.array_split(open_, parts):
            places = at[part, None] + step * (out[part, None] + np.arange(1, width + 1))
            same = words[np.clip(places, 0, last)] == words[np.clip(places - lag, 0, last)]
            whole = same.all(axis=1)
            out[part] += np.where(whole, width, same.argmin(axis=1))
            rest.append(part[whole & (out[part] < most)])
        open_ = np.concatenate(rest)
        width = min(2 * width, CELLS, most)
    return np.minimum(out, most)


def covered(at: np.ndarray, lag: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether a place and the place a lag earlier lie in one of the runs (start, last word, period)."""
    first, last = np.array([(start + lag, end) for start, end, _ in sorted(runs)]).T
    reach = np.maximum.accumulate(last)
    before = np.searchsorted(first, at, side="right") - 1
    return (before >= 0) & (reach[before] >= at)


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Per text, given as numbers of its words, its runs: rows of start, length and period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    stops = -np.arange(1, len(texts) + 2)
    pieces = [stops[:1]]
    for place, i in enumerate(order):
        pieces += [texts[i], stops[place + 1 : place + 2]]
    words = np.concatenate(pieces)
    ends = 1 + np.cumsum(sizes[order] + 1)  # behind the stop of each text
    falling = -sizes[order]
    out: list[tuple[int, int, int]] = []
    multiples: dict[int, list[tuple[int, int, int]]] = {}
    longest = int(sizes.max(initial=0))
    for lag in range(1, longest // LEAST_TIMES + 1) if longest >= LEAST_WORDS else ():
        least = max(LEAST_WORDS, LEAST_TIMES * lag)
        needed = least - lag
        texts_here = int(np.searchsorted(falling, -least, side="right"))
        at = np.arange((lag // needed + 1) * needed, ends[texts_here - 1], needed)
        at = at[words[at] == words[at - lag]]
        passed = multiples.pop(lag, [])
        if len(at) and passed:
            at = at[~covered(at, lag, passed)]
        if len(at):
            last = len(words) - 1
            sides = [np.clip(at[:, None] + step * NEAR, 0, last) for step in (1, -1)]
            near = [(words[p] == words[np.maximum(p - lag, 0)]).all(axis=1) for p in sides]
            at = at[near[0] | near[1]]
        if len(at):
            # a stretch that reaches the next place looked at goes on from there
            behind = matched(words, at, lag, 1, needed - 1)
            goes_on = np.append((np.diff(at) == needed) & (behind[:-1] == needed - 1), False)
            opens = at[~np.append(False, goes_on[:-1])]
            begins = opens - matched(words, opens, lag, -1, needed - 1)
            finish = (at + behind)[~goes_on]
            long_enough = finish - begins + 1 >= needed
            for first, end in zip(begins[long_enough].tolist(), finish[long_enough].tolist()):
                out.append((first - lag, end, lag))
                passed.append(out[-1])
        for run in passed:
            following = lag + run[2]
            if following <= min(run[1] - run[0], longest // LEAST_TIMES):
                multiples.setdefault(following, []).append(run)
    found = np.array(out, dtype=np.int64).reshape(-1, 3)
    owner = np.searchsorted(ends, found[:, 0], side="right")
    begins = (ends - sizes[order] - 1)[owner]
    rows = np.column_stack([found[:, 0] - begins, found[:, 1] - found[:, 0] + 1, found[:, 2]])
    by_text = np.lexsort((rows[:, 2], rows[:, 0], owner))
    rows, owner = rows[by_text], owner[by_text]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    result = [rows[:0]] * len(texts)
    for place, i in enumerate(order):
        result[i] = rows[cuts[place] : cuts[place + 1]]
    return result


def kept_words(n_words: int, runs: np.ndarray) -> np.ndarray:
    """A boolean per word: not behind the first period of any run that holds it."""
    change = np.zeros(n_words + 1, dtype=np.int32)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def collapsed(pieces: Iterator[list[bytes]], kept: np.ndarray) -> str:
    """The kept words of a text, joined by single spaces."""
    out, at = [], 0
    for words in pieces:
        keep = kept[at : at + len(words)]
        at += len(words)
        left = words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]
        if left:
            out.append(b" ".join(left))
    return b" ".join(out).decode()


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        numbers: dict[bytes, int] = {}
        data = [(t or "").encode() for t in column_of(batch).to_pylist()]
        split = [list(words_of(d)) if len(d) <= STRETCH else None for d in data]
        texts = []
        for whole, pieces in zip(data, split):
            coded = [np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64) for words in pieces or words_of(whole)]
            texts.append(np.concatenate(coded) if coded else np.zeros(0, np.int64))
        numbers.clear()
        runs = runs_of(texts)
        left = [collapsed(p if p is not None else words_of(d), kept_words(len(t), r)) for d, p, t, r in zip(data, split, texts, runs)]
        listed = [[{"start": a, "length": b, "period": c} for a, b, c in r.tolist()] for r in runs]
        columns = [
            batch.column("row"),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array(listed, RUNS),
            pa.array(left, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs, or the columns to keep, as struct `row`, with n_words, its runs and its collapsed text.

    A run is a stretch of words with smallest period q, of at least max(12, 2 * q) words, that no neighbouring word
    extends; runs holds start, length and period, by start, then period. collapsed is the text's words without those
    behind the first period of any run, joined by single spaces. Words are what blanks (ASCII) leave.
    """
    rows = packed_rows(docs, keep)
    found = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(_found, row_schema(rows, found))
