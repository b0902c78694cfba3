"""Benchmark decontamination with one Aho-Corasick automaton over the windows of test questions and answers.

Texts are normalised to words: A-Z lower-cased, words are stretches of digits, letters a-z and characters beyond ASCII.
Every distinct benchmark word gets a code of three letters, from an alphabet per place, and every other word blanks; so a
window of ten words is a pattern of thirty letters, no state has more than 64 followers, and a match ends with a word. A
document is scanned once, in stretches, the automaton's state carried from one to the next; word numbers of the matches
are mapped back to offsets in the original text.

Size: an automaton holds at most MOST_WORDS benchmark words. A larger benchmark is dealt by a hash of its stretches into
as many automata as it takes, one after the other over the documents, each adding its matches to those found before; so
neither the driver nor a task ever holds more than one. Very long items are cut into stretches that overlap by a window.

Cases: null, empty and wordless texts have no words and are clean. An item of fewer words than a window, but not none, is
one window. Windows of an item without an id are hit like others, but no item is named for them. Items that repeat an id
are one item; a window of several items names them all. Empty tables: no documents give no rows, no items leave all clean.
Repeated documents are rows of their own. Other columns are passed through unread, or left away (`keep`).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletscope.llm.common import checkpointed, column_of, packed_rows, row_schema, slices

WINDOW = 10
#: Most benchmark words of one automaton, and words of a stretch of a long item (and a window less one of the next).
MOST_WORDS, ITEM_WORDS = 250_000, 1_000
#: Bytes of a text that are split into words at once.
STRETCH = 1 << 22

#: Per byte: itself, in lower case, or a blank where it belongs to no word.
NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256)
)
#: Letters of a word's code and their values per place: enough for MOST_WORDS words.
PLACES, BASE = 3, 64
BLANK = " " * PLACES

FOUND = "n_words long, hits array<struct<first: long, last: long>>, items array<string>, spans array<struct<start: long, end: long>>"
HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def normal(text: str | None) -> bytes:
    return (text or "").encode().translate(NORMAL)


def stretches_of(data: bytes, size: int = STRETCH) -> Iterator[list[bytes]]:
    """The words of a normalised text, stretch by stretch; no word is cut."""
    start = 0
    while start < len(data):
        end = data.find(b" ", start + size) if start + size < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def _items(window: int, most: int):
    """item, words (joined by blanks) and n_words of each stretch of an item that begins a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = normal(text).decode().split(" ")
                words = [w for w in words if w]
                last = max(1, len(words) - window + 1) if words else 0
                out += [(item, words[i : min(i + most, last) + window - 1]) for i in range(0, last, most)]
            columns = [
                pa.array([item for item, _ in out], pa.string()),
                pa.array([" ".join(w) for _, w in out], pa.string()),
                pa.array([len(w) for _, w in out], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["item", "words", "n_words"])

    return run


class Watch:
    """The automaton of the windows of some items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.codes: dict[bytes, str] = {}
        windows: dict[str, set] = {}
        for item, text in items:
            coded = [self._code(w) for w in text.encode().split()]
            for i in range(max(1, len(coded) - window + 1)):
                windows.setdefault("".join(coded[i : i + window]), set()).add(item)
        self.items = [sorted(x for x in names if x is not None) for names in windows.values()]
        self.lengths = np.array([len(w) // PLACES for w in windows], dtype=np.int64)
        self.automaton = ahocorasick.Automaton()
        for number, pattern in enumerate(windows):
            self.automaton.add_word(pattern, number)
        if windows:
            self.automaton.make_automaton()

    def _code(self, word: bytes) -> str:
        number = len(self.codes)
        return self.codes.setdefault(
            word, "".join(chr(0x100 + place * BASE + number // BASE ** (PLACES - 1 - place) % BASE) for place in range(PLACES))
        )

    def scan(self, data: bytes) -> tuple[int, np.ndarray, np.ndarray, set[str]]:
        """Number of words of a normalised text; first and last word of every match; the items matched."""
        total, ends, found = 0, [], []
        search = self.automaton.iter("") if len(self.lengths) else None
        for words in stretches_of(data):
            total += len(words)
            if search is not None:
                search.set("".join(map(self.codes.get, words, repeat(BLANK))))
                for end, number in search:
                    ends.append(end // PLACES)
                    found.append(number)
        last = np.array(ends, dtype=np.int64)
        first = last - self.lengths[found] + 1 if ends else last
        return total, first, last, {item for number in set(found) for item in self.items[number]}


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of words that lie in any of the given ones."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    begins = np.concatenate([[True], first[1:] > reach[:-1] + 1])
    return first[begins], reach[np.append(np.flatnonzero(begins)[1:] - 1, len(reach) - 1)]


def offsets(data: bytes, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Start and end, in code points of the original text, of stretches of words; data: the text normalised."""
    inside = np.frombuffer(data, dtype=np.uint8) != 32
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))[first]
    ends = np.flatnonzero(inside & ~np.append(inside[1:], False))[last] + 1
    out, at, chars = [], 0, 0
    for start, end in zip(starts.tolist(), ends.tolist()):
        begin = chars + len(data[at:start].decode())
        chars = begin + len(data[start:end].decode())
        out.append((begin, chars))
        at = end
    return out


#: The automaton last built in this worker, by the number of its benchmark part.
_BUILT: dict[str, Watch] = {}


def _scanned(items: list[tuple[str | None, str]], window: int, last_part: bool):
    """Adds the matches of one automaton; with the last one, the spans."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Watch(items, window)
        watch = _BUILT[name]
        for batch in slices(batches):
            counts, all_hits, all_items, all_spans = [], [], [], []
            earlier = "hits" in batch.schema.names
            before = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist()) if earlier else repeat(((), ()))
            for text, (old_hits, old_items) in zip(column_of(batch).to_pylist(), before):
                data = normal(text)
                total, first, last, named = watch.scan(data)
                spans = []
                if len(first) or old_hits:
                    first = np.concatenate([first, np.array([h["first"] for h in old_hits], np.int64)])
                    last = np.concatenate([last, np.array([h["last"] for h in old_hits], np.int64)])
                    first, last = merged(first, last)
                    spans = offsets(data, first, last) if last_part else []
                counts.append(total)
                all_hits.append([{"first": a, "last": b} for a, b in zip(first.tolist(), last.tolist())])
                all_items.append(sorted(named.union(old_items)))
                all_spans.append([{"start": a, "end": b} for a, b in spans])
            kept = [n for n in ("row", "text") if n in batch.schema.names]
            columns = [pa.array(counts, pa.int64()), pa.array(all_hits, HITS), pa.array(all_items, pa.list_(pa.string())), pa.array(all_spans, SPANS)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *columns], [*kept, "n_words", "hits", "items", "spans"])

    return run


def parts_of(stretches: DataFrame, most: int) -> int:
    """Into how many parts a hash deals the benchmark so that none has more than so many words.

    Ends, since a stretch is far shorter than `most` and repeated ones are gone.
    """
    parts = 1
    while True:
        sums = stretches.groupBy(F.pmod(F.xxhash64("item", "words"), F.lit(parts))).agg(F.sum("n_words").alias("n"))
        largest = sums.agg(F.max("n")).first()[0] or 0
        if largest <= most:
            return parts
        parts = max(parts + 1, math.ceil(1.2 * parts * largest / most))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, most: int = MOST_WORDS
) -> DataFrame:
    """Every row of docs, or the columns to keep, as struct `row`, with what it shares with the benchmark.

    n_words; n_hit, the words inside a window that occurs; items, the ids (as text, sorted) of the items with an
    occurring window; spans, the stretches of hit words as start and end (behind the last) in the original text.
    benchmark: item_id and text. most: words of one automaton, at least two stretches of an item.
    """
    read = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    layout = "item string, words string, n_words long"
    stretches = checkpointed(read.mapInArrow(_items(window, min(ITEM_WORDS, max(1, most // 4))), layout).distinct())
    parts = parts_of(stretches, most)
    rows = packed_rows(docs, keep)
    more = "text string, " if "text" in rows.columns else ""
    schema = row_schema(rows, more + FOUND)
    for part in range(parts):
        own = stretches.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part)
        items = [(r.item, r.words) for r in own.select("item", "words").collect()]  # at most `most` words
        rows = rows.mapInArrow(_scanned(items, window, part == parts - 1), schema)
        if part < parts - 1:
            rows = checkpointed(rows)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    return rows.select("row", "n_words", n_hit.alias("n_hit"), "items", "spans")
