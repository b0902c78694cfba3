"""Token counts of a text's sections, by mapping tokens back to characters.

Every text is encoded once, whole, so that no token depends on where sections begin. The bytes of the tokens give
each token's span, and spans are joined to the sections' spans in order. A token that crosses a border is allocated by
a rule: "first" gives it to the section that holds its first byte, "most" to the section that holds most of its bytes
(ties to the earlier), "share" to each section by its part of the bytes.

Sections are the lines of a text, each with its line feed. Their counts add up to the text's tokens.

Cases: a null or empty text is one empty section without tokens. A null id is passed through. Repeated rows are
counted as often as they occur. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletscope.llm.common import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary splits a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "most", "share")
LINE_FEED = 10


class Encoder:
    """The tokens of texts with the number of bytes of each; loaded once per process."""

    loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("sections", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def ends(self, text: str) -> np.ndarray:
        """Where each token of the text ends, in bytes."""
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), dtype=np.int64)])


def borders(raw: bytes) -> np.ndarray:
    """Where each section ends, in bytes."""
    feeds = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == LINE_FEED) + 1
    return feeds if len(feeds) and feeds[-1] == len(raw) else np.append(feeds, len(raw))


def attributed(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section, both given by their ends in order."""
    starts = np.concatenate([[0], token_ends[:-1]]).astype(np.int64) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, side="right")
    out = np.zeros(len(section_ends))
    last = np.searchsorted(section_ends, token_ends, side="left")
    whole = first == last if rule != "first" else np.ones(len(starts), dtype=bool)
    out += np.bincount(first[whole], minlength=len(out))
    for start, end, a, b in zip(starts[~whole], token_ends[~whole], first[~whole], last[~whole]):
        inside = np.minimum(section_ends[a : b + 1], end) - np.maximum(np.concatenate([[0], section_ends])[a : b + 1], start)
        if rule == "share":
            out[a : b + 1] += inside / (end - start)
        else:
            out[a + int(inside.argmax())] += 1
    return out


def section_tokens(docs: DataFrame, rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, section (from 0), first_char, n_chars and tokens of every section, doc_tokens of its text."""
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    schema = "doc_id long, section int, first_char long, n_chars long, tokens double, doc_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in slices(batches):
            ids, numbers, firsts, lengths, counts, totals = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = (text or "").encode()
                ends, sections = encoder.ends(text or ""), borders(raw)
                # characters begin at the bytes that don't continue one
                chars = np.concatenate([[0], np.cumsum(np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80)])[np.concatenate([[0], sections])]
                n = len(sections)
                ids += [doc_id] * n
                numbers.append(np.arange(n, dtype=np.int32))
                firsts.append(chars[:-1])
                lengths.append(np.diff(chars))
                counts.append(attributed(ends, sections, rule))
                totals.append(np.full(n, len(ends)))
            joined = [np.concatenate(x) for x in (numbers, firsts, lengths, counts, totals)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, joined)], [f.split()[0] for f in schema.split(", ")])

    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, schema)
