"""Contamination, periodic runs, hard negatives and top-k rows against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from outletscope.llm import contamination, negatives, periodic, queries, topk
from outletscope.llm.common import slices
from tests.llm.conftest import ODD, ODD_ITEMS, ODD_VECTORS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_contamination(text, items, window=10):
    """n_words, hit spans in characters, n_hit and item ids, by comparing every window with every place."""
    found = list(WORD.finditer(lowered(text)))
    words = [m[0] for m in found]
    places = defaultdict(list)
    for size in range(1, window + 1):
        for i in range(len(words) - size + 1):
            places[tuple(words[i : i + size])].append(i)
    hit, named = set(), set()
    for item, item_text in items:
        own = WORD.findall(lowered(item_text))
        size = min(window, len(own))
        for i in range(len(own) - size + 1) if own else ():
            for at in places.get(tuple(own[i : i + size]), ()):
                hit.update(range(at, at + size))
                named.add(item)
    spans = []
    for i in sorted(hit):
        if spans and spans[-1][2] == i - 1:
            spans[-1][1:] = [found[i].end(), i]
        else:
            spans.append([found[i].start(), found[i].end(), i])
    return len(words), len(hit), sorted(str(x) for x in named if x is not None), [(a, b) for a, b, _ in spans]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame(ODD_ITEMS, "item_id long, text string")


@pytest.mark.parametrize("most", [contamination.MOST_WORDS, 6_000])
def test_contamination_of_odd_documents(documents, benchmark, most):
    """With one automaton, and with many: the long item alone has 60,000 words."""
    docs = documents([*ODD, (20, "the seventh, THE SEVENTH; ünï the seventh é", "en")])
    found = contamination.contaminated(docs, benchmark, most=most)
    assert found.schema["row"].dataType.names == docs.columns
    rows = found.collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        n_words, n_hit, items, spans = plain_contamination(r.row.text, ODD_ITEMS)
        assert (r.n_words, r.n_hit, r["items"]) == (n_words, n_hit, items)
        assert [(s.start, s.end) for s in r.spans] == spans


def test_windows_across_stretches(monkeypatch):
    monkeypatch.setattr(contamination.stretches_of, "__defaults__", (7,))
    text = "Alpha, beta gamma DELTA epsilon zeta eta theta iota kappa lambda mu"
    watch = contamination.Watch([("x", "beta gamma delta epsilon zeta eta theta iota kappa lambda")])
    total, first, last, items = watch.scan(contamination.normal(text))
    assert (total, first.tolist(), last.tolist(), items) == (12, [1], [10], {"x"})


def test_one_automaton_takes_as_many_words_as_it_may():
    assert contamination.BASE**contamination.PLACES >= contamination.MOST_WORDS
    watch = contamination.Watch([(str(i), f"w{i}") for i in range(70_000)])
    assert len(set(watch.codes.values())) == 70_000
    assert watch.scan(b"w69999 w0 other w70000 w4096")[3] == {"69999", "0", "4096"}


def plain_runs(words):
    """(start, length, period) of every run, period by period."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = q
        while i < len(words):
            end = i
            while end < len(words) and words[end] == words[end - q]:
                end += 1
            start, length = i - q, end - i + q
            smaller = (p for p in range(1, q) if all(words[x] == words[x - p] for x in range(start + p, end)))
            if length >= max(12, 2 * q) and next(smaller, None) is None:
                out.append((start, length, q))
            i = max(end, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = [rng.randrange(rng.choice([1, 2, 2, 3, 20])) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.6 and words:
                a, p = rng.randrange(len(words)), rng.randint(1, 12)
                words = [words[min(i, a + (i - a) % p)] if i >= a else words[i] for i in range(len(words))]
            if rng.random() < 0.3:
                words += words[: rng.randint(0, len(words))]
            texts.append(np.array(words, dtype=np.int64))
        for words, found in zip(texts, periodic.runs_of(texts)):
            assert [tuple(r) for r in found.tolist()] == plain_runs(words.tolist())


def test_runs_of_long_texts():
    assert periodic.runs_of([np.zeros(200_000, np.int64)])[0].tolist() == [[0, 200_000, 1]]
    block = np.concatenate([np.arange(1_000), np.arange(1_000)])
    assert periodic.runs_of([np.concatenate([block, -5 * np.ones(1, np.int64)]), block])[1].tolist() == [[0, 2_000, 1_000]]


def altered(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    words = altered(doc_id, (text or "").encode().split())
    runs = plain_runs(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_query_against_brute_force(spark, corpus):
    texts = {r.doc_id: r.text for r in corpus(0.01).collect()}
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.01").collect()}
    assert found.keys() == texts.keys()
    short = [i for i, t in texts.items() if len(t or "") < 2_500]
    assert len(short) > 500 and sum(found[i][1] > 0 for i in short) > 40
    assert all(found[i] == plain_row(i, texts[i]) for i in short)


def test_periodic_odd_documents(spark, folder, documents, monkeypatch):
    odd = [r for r in ODD if len(r[1] or "") < 10_000]
    odd += [(i, " a\tb\x0bc" * 20 + "  d" * i, "en") for i in range(30, 50)]
    found = queries.op12_periodic_runs(spark, folder(odd)).collect()
    assert sorted(map(repr, (tuple(r[c] for c in COLUMNS) for r in found))) == sorted(repr(plain_row(i, t)) for i, t, _ in odd)
    docs = documents([(1, "x " * 40 + "é\x1fy", "en")])
    row = periodic.periodic_runs(docs).collect()[0]
    assert row.row == docs.collect()[0] and row.collapsed == "x é\x1fy" and [tuple(r) for r in row.runs] == [(0, 40, 1)]


def test_words_cut_in_stretches():
    data = "ab  c d\x0bééé fg\n".encode() * 9
    assert [w for words in periodic.words_of(data, 3) for w in words] == data.split()


def plain_negatives(rows):
    """rows: distinct (id, label, vector of whole numbers)."""
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    for a in rows:
        if a[0] % 50:
            continue
        others = [(score(a, b), b) for b in rows if b[0] != a[0] and len(b[2]) == len(a[2])]
        positives = sorted(((s, b) for s, b in others if b[1] == a[1]), key=lambda x: (-x[0], x[1][0]))[:5]
        for s, p in positives:
            near = sorted((-t, b[0]) for t, b in others if b[1] != a[1] and 50 * s <= 100 * t <= 95 * s)[:3]
            out += [(a[0], p[0], rank, b, s, -t) for rank, (t, b) in enumerate(near, 1)]
    return sorted(out)


def usable(rows, scale=256):
    """Distinct rows that take part, labels as the query sets them."""
    good = [
        (i, label, v) for i, v, label in rows if None not in (i, label) and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    return sorted({(i, (c + 1) % 10 if i % 7 == 0 else c, tuple(math.floor(scale * float(np.float32(x))) for x in v)) for i, c, v in good})


@pytest.mark.parametrize("cells", [negatives.CELLS, 100])
def test_hard_negatives_of_random_vectors(spark, cells):
    rng = np.random.default_rng(3)
    rows = [(int(i) * 5, int(rng.integers(3)), tuple(map(int, rng.integers(-9, 30, size=rng.choice([5, 5, 5, 20]))))) for i in range(120)]
    rows += [(i + 1, label, v) for i, label, v in rows[:30]]  # ties
    frame = spark.createDataFrame(rows + rows[:9], "id long, label int, vector array<long>")
    found = negatives.hard_negatives(frame, frame.where("id % 50 = 0"), cells=cells)
    expected = plain_negatives(rows)
    assert len(expected) > 50 and sorted(map(tuple, found.collect())) == expected


def test_hard_negatives_query_of_odd_vectors(spark, folder):
    found = queries.op13_hard_negatives(spark, folder())
    assert sorted(map(tuple, found.collect())) == plain_negatives(usable(ODD_VECTORS))


def test_top_k_query_of_odd_vectors(spark, folder):
    rows = {(i, v) for i, _, v in usable([(i, v, 0) for i, v, _ in ODD_VECTORS], 1024)}
    best = defaultdict(list)
    for own, q in rows:
        if own % 100 == 0:
            best[own] += [(-sum(x * y for x, y in zip(q, v)), i) for i, v in rows if i != own and len(v) == len(q)]
    expected = sorted((own, rank, i, -s) for own, found in best.items() for rank, (s, i) in enumerate(sorted(found)[:10], 1))
    assert sorted(map(tuple, queries.op8_bit_sliced(spark, folder()).collect())) == expected


def test_segments_bound_the_scores():
    rng = np.random.default_rng(5)
    matrix = rng.integers(-400, 400, size=(300, 64))
    part = negatives.Part(np.arange(300), np.zeros(300, np.int64), np.zeros(300, np.int64), matrix)
    vector = rng.integers(-400, 400, size=64)
    anchor = [(m[0], d[0]) for m, d in negatives.summaries(vector[None].astype(float))]
    widths = []
    for level in range(len(negatives.LEVELS)):
        low, high = part.bounds(level, np.arange(300), anchor)
        assert (low <= matrix @ vector).all() and (matrix @ vector <= high).all()
        widths.append((high - low).mean())
    assert widths == sorted(widths, reverse=True)


def test_slices_read_the_text_inside_of_a_row(documents):
    rows = documents().select(F.struct("doc_id", "text").alias("row"))
    assert sum(b.num_rows for b in slices(iter(rows.toArrow().to_batches()), chars=50)) == len(ODD)


def test_blocks_do_not_depend_on_the_order_of_rows(spark):
    """A partition that is read anew in another order gives the same blocks, and one block meets all queries."""
    rows = [(i, [i % 7, -i]) for i in range(500)]
    packs = []
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "id long, vector array<long>").repartition(3)
        packs.append(sorted((r.dim, bytes(r.ids), bytes(r.vectors)) for r in topk.packed(frame, 64).collect()))
    assert packs[0] == packs[1] and len(packs[0]) >= 8
    frame = spark.createDataFrame(rows, "id long, vector array<long>")
    plan = topk.top_k(frame, frame.where("id % 100 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("monotonically_increasing_id") == 0
