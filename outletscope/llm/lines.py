"""Line dedup: lines repeated over many documents stay in one of them.

Hashes of the lines' keys are range-partitioned with document and position behind them, so a line of a third of all
documents is spread over many partitions. Each sorted partition is streamed once: a run of one hash is decided as it
passes, and only the first and last run of a partition, which may go on next door, wait for the few totals of such
runs. What comes back is a compressed bitmap of kept lines per document, no text; `deduplicated` applies it.

Cases: a null or empty text is one empty line. A null doc_id is no document: its lines are neither counted nor
dropped. Rows that repeat a doc_id are one document; rows that repeat doc_id and text share their bitmap. A text whose
lines all go becomes empty. An empty table gives an empty result. Other columns are passed through unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from outletscope.llm.common import checkpointed, column_of, packed_rows, partitions_of, row_schema, slices

MIN_CHARS = 40
MIN_DOCS = 5
#: Blanks stripped from a key.
BLANKS = b" \t\n\x0b\x0c\r"

LINES = "high long, low long, doc_id long, text_id long, position int"
RUNS = f"{LINES}, decided boolean, starts int"
#: A run of more lines is not held in memory until it ends.
HOLD = 100_000
#: Parts that the lines of a run which crosses partitions are dealt into.
SALTS = 64


def keys(text: str | None) -> list[bytes]:
    """The keys of a text's lines: stripped of blanks, A-Z lower-cased."""
    return [line.strip(BLANKS) for line in (text or "").encode().lower().split(b"\n")]


def text_id(text: str | None) -> int:
    """Tells texts of a repeated doc_id apart."""
    return int(np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42)).astype(np.int64))


def _hashed(min_chars: int):
    """Rows of LINES of the lines whose keys are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, ids, texts, positions = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = None
                for position, key in enumerate(keys(text)):
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        own = text_id(text) if own is None else own
                        digests.append(xxhash.xxh3_128_digest(key))
                        ids.append(doc_id)
                        texts.append(own)
                        positions.append(position)
            halves = np.frombuffer(b"".join(digests), dtype=">i8").reshape(-1, 2).astype(np.int64)
            columns = [halves[:, 0], halves[:, 1], np.array(ids, np.int64), np.array(texts, np.int64), np.array(positions, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["high", "low", "doc_id", "text_id", "position"])

    return run


ORDER = ["high", "low", "doc_id", "text_id", "position"]


def _numbered(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin, and whether a line begins a document of its run."""
    turn = np.concatenate([[True], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)])
    return np.flatnonzero(turn), turn | np.concatenate([[True], np.diff(rows[2]) != 0])


def _out(rows: list[np.ndarray], decided: bool, starts: np.ndarray) -> pa.RecordBatch:
    more = [pa.array(np.full(len(rows[0]), decided)), pa.array(starts.astype(np.int32))]
    return pa.RecordBatch.from_arrays([*map(pa.array, rows), *more], [*ORDER, "decided", "starts"])


def _closed(rows: list[np.ndarray], min_docs: int) -> pa.RecordBatch:
    """The lines to drop of whole runs: all of a frequent run but those of its largest document."""
    turn, begins = _numbered(rows)
    ends = np.append(turn[1:], len(rows[0]))
    begun = np.cumsum(begins)
    docs = begun[ends - 1] - begun[turn] + 1
    last = np.flatnonzero(begins)[begun[ends - 1] - 1]
    lengths = ends - turn
    drop = np.repeat(docs >= min_docs, lengths) & (np.arange(len(rows[0])) < np.repeat(last, lengths))
    return _out([c[drop] for c in rows], True, begins[drop])


def _streamed(min_docs: int):
    """Rows of RUNS from sorted LINES: the lines to drop of runs that lie inside the partition (decided), and all lines
    of its first and last run, and of runs too long to hold (undecided); starts marks a document's first line in a run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.int32)]
        loose = True  # the open run may have begun elsewhere, or part of it has left
        before = None  # hash and document of the last line that left undecided

        def undecided(rows: list[np.ndarray]) -> pa.RecordBatch:
            starts = _numbered(rows)[1]
            starts[0] = before != tuple(int(c[0]) for c in rows[:3])
            return _out(rows, False, starts)

        for batch in batches:
            if not batch.num_rows:
                continue
            rest = [np.concatenate([c, batch.column(n).to_numpy(zero_copy_only=False)]) for c, n in zip(rest, ORDER)]
            turn = _numbered(rest)[0]
            if len(turn) > 1:
                inside = int(turn[1]) if loose else 0
                if loose:
                    yield undecided([c[:inside] for c in rest])
                if turn[-1] > inside:
                    yield _closed([c[inside : turn[-1]] for c in rest], min_docs)
                rest, loose, before = [c[turn[-1] :] for c in rest], False, None
            if len(rest[0]) > HOLD:
                yield undecided(rest)
                before, loose = tuple(int(c[-1]) for c in rest[:3]), True
                rest = [c[:0] for c in rest]
        if len(rest[0]):
            yield undecided(rest)

    return run


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_id and position of every line to drop (rows repeat where documents do)."""
    read = docs.where("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"))
    lines = read.mapInArrow(_hashed(min_chars), LINES).repartitionByRange(partitions_of(docs), *ORDER)
    runs = checkpointed(
        lines.sortWithinPartitions(*ORDER).mapInArrow(_streamed(min_docs), RUNS).withColumn("part", F.spark_partition_id())
    )
    undecided = runs.where("NOT decided")
    # one row per open run and partition: a document cut by a border is counted on both sides of it
    spans = undecided.groupBy("high", "low", "part").agg(
        F.sum("starts").alias("docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )
    border = F.lag("last_doc").over(Window.partitionBy("high", "low").orderBy("part"))
    frequent = (
        spans.withColumn("docs", F.col("docs") - F.when(border == F.col("first_doc"), 1).otherwise(0))
        .groupBy("high", "low")
        .agg(F.sum("docs").alias("docs"), F.max("last_doc").alias("last_doc"))
        .where(F.col("docs") >= min_docs)
        .select("high", "low", "last_doc")
    )
    place = ["doc_id", "text_id", "position"]
    # the lines of a very frequent run are dealt out over salts, each of which gets its verdict
    salted = undecided.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    verdicts = frequent.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    settled = salted.join(verdicts, ["high", "low", "salt"]).where("doc_id < last_doc").select(*place)
    return runs.where("decided").select(*place).unionByName(settled)


def packed(dropped: list[int]) -> bytes:
    """The keep bitmap of a document: a bit per line, 1 for kept, in whole bytes up to the last line dropped; deflated."""
    keep = np.ones((max(dropped) // 8 + 1) * 8, dtype=np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def unpacked(keep: bytes, n_lines: int) -> np.ndarray:
    """A boolean per line from a keep bitmap; lines behind its end are kept."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), bitorder="little")[:n_lines]
    return np.concatenate([bits, np.ones(n_lines - len(bits), dtype=np.uint8)]).astype(bool)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bitmaps = [packed(x) for x in batch.column("dropped").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_id"), pa.array(bitmaps, pa.binary())], ["doc_id", "text_id", "keep"]
        )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_id and keep (see `packed`) of every document that loses lines."""
    dropped = repeated_lines(docs, min_chars, min_docs)
    return (
        dropped.groupBy("doc_id", "text_id")
        .agg(F.collect_set("position").alias("dropped"))
        .mapInArrow(_packed, "doc_id long, text_id long, keep binary")
    )


def kept_text(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """The text without dropped lines, the number of its lines and how many of them are dropped."""
    if keep is None:
        return text or "", (text or "").count("\n") + 1, 0
    lines = text.split("\n")
    kept = unpacked(keep, len(lines))
    return "\n".join(line for line, k in zip(lines, kept) if k), len(lines), int((~kept).sum())


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Every row of docs as struct `row`, with kept (its text without the dropped lines), n_lines and n_dropped."""
    bitmaps = keep_bitmaps(docs, min_chars, min_docs).withColumnsRenamed({"doc_id": "kept_id", "text_id": "kept_text_id"})
    # the text travels once, inside of its row
    marked = docs.withColumns({"_own_id": F.col("doc_id"), "_own_text_id": F.xxhash64(F.col("text").cast("string"))})
    rows = packed_rows(marked, docs.columns, ["_own_id", "_own_text_id"])
    joined = rows.join(bitmaps, (F.col("_own_id") == F.col("kept_id")) & (F.col("_own_text_id") == F.col("kept_text_id")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [kept_text(t.as_py(), k.as_py()) for t, k in zip(column_of(batch), batch.column("keep"))]
            kept, lines, dropped = zip(*found) if found else ([], [], [])
            columns = [batch.column("row"), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "kept", "n_lines", "n_dropped"])

    texts = [c for c in ("text",) if c in rows.columns]
    selected = joined.select("row", *texts, "keep")
    return selected.mapInArrow(run, row_schema(rows, "kept string, n_lines long, n_dropped long"))
