"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are concatenated and indexed by a suffix array, sorted as deep as the longest piece.
Binary search finds every piece's range of occurrences; the occurrences are laid out by position and length, as edges
from their first character, and relaxed: in each round every word joins its best-scoring edge that spans two neighbours
(ties to the left), until none is left. That is how the byte-pair vocabulary defines its segmentation, so the ids equal the
library's. Characters without a piece become byte pieces.

The vocabulary never joins across the beginning of a word (a blank behind something else), which is checked when it is
loaded; so a text's ids are the ids of its words in a row.

A word is segmented in memory; one of n characters without a blank takes about 100 n bytes.

Cases: a null text has null ids and is decoded to null; an empty one has none and is decoded to "". Every text without
the blank sign U+2581 comes back exactly; that sign comes back as a space, as in the library. A null id is passed
through. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletscope.llm.common import slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
WORD = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
#: Characters of distinct words indexed at once; a longer word is indexed alone.
INDEXED = 1 << 18
#: Words remembered per process in each of two generations, and the longest of them.
REMEMBERED, LONG_WORD = 200_000, 64
NONE = np.int64(1) << 40


class Vocabulary:
    """Pieces with their ranks (0 is the best score), single characters, bytes."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.piece = {i: model.id_to_piece(i) for i in plain}
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.piece.values()):
            raise ValueError("a piece goes across words")
        self.ids = np.array(plain, dtype=np.int64)
        self.longest = max(map(len, self.piece.values()))
        self.texts = np.array([self.piece[i] for i in plain], dtype=f"U{self.longest}")
        self.past = np.array([self.piece[i].ljust(self.longest, "\U0010ffff") for i in plain], dtype=f"U{self.longest}")
        scores = np.array([model.get_score(i) for i in plain])
        self.rank = np.full(len(ids), NONE)
        self.rank[self.ids] = np.unique(-scores, return_inverse=True)[1]
        self.single = {p: i for i, p in self.piece.items() if len(p) == 1}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = {i: b for b, i in enumerate(self.byte)}
        self.decoded = [b""] * len(ids)
        for i, piece in self.piece.items():
            self.decoded[i] = piece.replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte):
            self.decoded[i] = bytes([b])


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the text behind them, which is compared over depth characters at least."""
    alphabet, units = np.unique(codes, return_inverse=True)
    bits = int(len(alphabet)).bit_length()
    each = max(1, 62 // bits)
    padded = np.concatenate([units.astype(np.int64) + 1, np.zeros(each, np.int64)])
    key = np.zeros(len(codes), dtype=np.int64)
    for place in range(each):
        key = key << bits | padded[place : place + len(codes)]
    order = np.argsort(key, kind="stable")
    known = each
    while known < depth:
        ranks = np.empty(len(codes), dtype=np.int64)
        ranks[order] = np.cumsum(np.concatenate([[1], np.diff(key[order]) != 0]))
        behind = np.concatenate([ranks, np.zeros(known, np.int64)])[known : known + len(codes)]
        key = ranks << 31 | behind
        order = np.argsort(key, kind="stable")
        known *= 2
    return order


def edges(text: str, vocabulary: Vocabulary) -> np.ndarray:
    """Piece ids by position and length: row i holds, at place n - 1, the piece of n characters that begins at i; else -1."""
    depth = vocabulary.longest
    if len(text) > INDEXED + depth:  # a long word, in overlapping stretches
        cut = range(0, len(text), INDEXED)
        return np.concatenate([edges(text[a : a + INDEXED + depth], vocabulary)[: INDEXED] for a in cut])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    order = suffix_array(codes, depth)
    padded = np.concatenate([codes, np.zeros(depth, dtype="<u4")])
    sorted_texts = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[order]).view(f"<U{depth}")[:, 0]
    low = np.searchsorted(sorted_texts, vocabulary.texts, side="left")
    high = np.searchsorted(sorted_texts, vocabulary.past, side="right")
    many = high - low
    piece = np.repeat(np.arange(len(low)), many)
    position = order[np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
    length = np.char.str_len(vocabulary.texts)[piece]
    table = np.full((len(codes), depth), -1, dtype=np.int32)
    table[position, length - 1] = vocabulary.ids[piece]
    return table


def relaxed(table: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments (word, first, end) of all words, which begin at starts and follow each other in the table.

    Every round joins, in each word, the two neighbours whose joint edge ranks best, leftmost of equals.
    """
    n, depth = table.shape
    first = np.arange(n)
    end = first + 1
    word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))

    def score(i: np.ndarray) -> np.ndarray:
        """Rank of the edge over the segments i and i + 1."""
        j = np.minimum(i + 1, len(first) - 1)
        span = end[j] - first[i]
        fits = (j > i) & (word[j] == word[i]) & (span <= depth)
        piece = np.where(fits, table[first[i], np.minimum(span, depth) - 1], -1)
        return np.where(piece >= 0, rank[piece], NONE)

    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    scores = score(np.arange(n))
    while len(first):
        turn = np.flatnonzero(np.concatenate([[True], np.diff(word) != 0]))
        best = np.minimum.reduceat(scores << 22 | np.arange(len(first)), turn)
        open_word = best >> 22 < NONE
        if not open_word.all():
            ends_here = ~np.repeat(open_word, np.diff(np.append(turn, len(first))))
            done.append((word[ends_here], first[ends_here], end[ends_here]))
            stays = ~ends_here
            moved = np.cumsum(stays) - 1
            best = moved[best[open_word] & ((1 << 22) - 1)]
            word, first, end, scores = word[stays], first[stays], end[stays], scores[stays]
        else:
            best = best & ((1 << 22) - 1)
        if not len(best):
            break
        end[best] = end[best + 1]
        keep = np.ones(len(first), dtype=bool)
        keep[best + 1] = False
        moved = np.cumsum(keep) - 1
        word, first, end, scores = word[keep], first[keep], end[keep], scores[keep]
        at = moved[best]
        scores[at] = score(at)
        left = at[at > 0] - 1
        scores[left] = score(left)
    words, firsts, ends = (np.concatenate(x) for x in zip(*done))
    place = np.argsort(firsts, kind="stable")
    return words[place], firsts[place], ends[place]


def relaxed_long(table: np.ndarray, rank: np.ndarray) -> list[tuple[int, int]]:
    """Segments of one long word, with its open edges in a heap."""
    n, depth = table.shape
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = end[i]
        if j < n and end[j] - i <= depth and (piece := table[i, end[j] - i - 1]) >= 0:
            heapq.heappush(heap, (int(rank[piece]), i, end[j]))

    for i in range(n):
        push(i)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] == n or end[end[i]] != stop or end[i] >= stop:
            continue
        gone = end[i]
        alive[gone], end[i] = False, stop
        if stop < n:
            before[stop] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append((i, end[i]))
        i = end[i]
    return out


class Codec:
    """Encoder and decoder with a bounded memory of words; loaded once per process.

    A full memory becomes the older one, from which a word that comes again is taken over; so frequent words stay and
    the others are forgotten.
    """

    loaded: dict[str, Codec] = {}

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def _ids(self, text: str, table: np.ndarray, first: int, end: int) -> list[int]:
        piece = int(table[first, end - first - 1])
        return [piece] if piece >= 0 else [self.vocabulary.byte[b] for b in text[first:end].encode()]

    def _indexed(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words, packed, in their order."""
        text = "".join(words)
        table = edges(text, self.vocabulary)
        if len(words) == 1 and len(text) > LONG_WORD:
            ids = [x for a, b in relaxed_long(table, self.vocabulary.rank) for x in self._ids(text, table, a, b)]
            yield np.array(ids, np.int32).tobytes()
            return
        lengths = np.array([len(w) for w in words])
        word, first, end = relaxed(table, np.cumsum(lengths) - lengths, self.vocabulary.rank)
        piece = table[first, end - first - 1]
        missing = np.flatnonzero(piece < 0)
        if not len(missing):
            flat, many = piece, np.bincount(word, minlength=len(words))
        else:  # single characters without a piece
            as_bytes = [[self.vocabulary.byte[b] for b in text[first[i] : end[i]].encode()] for i in missing]
            width = np.ones(len(piece), dtype=np.int64)
            width[missing] = [len(b) for b in as_bytes]
            flat = np.repeat(piece, width)
            flat[np.repeat(piece < 0, width)] = np.concatenate(as_bytes)
            many = np.bincount(np.repeat(word, width), minlength=len(words))
        packed = flat.astype(np.int32).tobytes()
        stops = np.cumsum(many) * 4
        for a, b in zip((stops - many * 4).tolist(), stops.tolist()):
            yield packed[a:b]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of new words."""
        out: dict[str, bytes] = {}
        group, size = [], 0
        for word in sorted(words):
            if len(word) > LONG_WORD:
                out[word] = next(self._indexed([word]))
                continue
            if size + len(word) > INDEXED:
                out.update(zip(group, self._indexed(group)))
                group, size = [], 0
            group.append(word)
            size += len(word)
        if group:
            out.update(zip(group, self._indexed(group)))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit numbers."""
        split = [WORD.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        distinct = set().union(*split)
        found = {w: self.known[w] for w in distinct if w in self.known}
        again = {w: self.older[w] for w in distinct if w in self.older and w not in found}
        fresh = again | self._learn(distinct.difference(found, again))
        found |= fresh
        if len(fresh) <= REMEMBERED:
            if len(self.known) + len(fresh) > REMEMBERED:
                self.known, self.older = {}, self.known
            self.known.update((w, i) for w, i in fresh.items() if len(w) <= LONG_WORD)
        return [b"".join(map(found.__getitem__, words)) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: blanks for blank signs, bytes for byte pieces, without the blank added in front."""
        raw = b"".join(map(self.vocabulary.decoded.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and token_ids of every row, and round_trip: whether the ids decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            packed = [np.frombuffer(x, np.int32) for x in codec.encode([t or "" for t in texts])]
            exact = [None if t is None else codec.decode(x) == t.replace(BLANK, " ") for t, x in zip(texts, packed)]
            sizes = np.array([len(x) for x in packed])
            empty = np.array([t is None for t in texts])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(empty, False))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*packed, np.zeros(0, np.int32)])))
            counts = pa.array(sizes, pa.int64(), mask=empty)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, lists, pa.array(exact, pa.bool_())], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decoded(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows of doc_id and token_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, dtype=np.int64)) for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
