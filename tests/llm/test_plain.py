"""Language and toxicity against plain readings of their methods, over whole corpora."""

from __future__ import annotations

import math
import subprocess
import sys
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from outletscope.llm import language, queries, toxicity
from outletscope.llm.common import held_out
from outletscope.llm.ngrams import hashed

SF = "/root/testdata/sf0.01"


# --- language


def plain_letters(text):
    """A letter in lower case, else a space, a space at both ends."""
    out = []
    for char in f" {text} ":
        low = char.lower()
        out.append((low if len(low) == 1 else char) if char.isalpha() else " " if ord(char) < 1 << 16 else char)
    return "".join(out)


def plain_ngrams(text):
    """Counts of (order, bucket)."""
    letters = plain_letters(text)
    found = Counter()
    for order in language.ORDERS:
        for i in range(len(letters) - order + 1):
            gram = letters[i : i + order]
            if gram.strip(" "):
                found[order, gram] += 1
    out = Counter()
    for (order, gram), n in found.items():
        bucket = int(hashed(np.array([ord(c) for c in gram], dtype=np.uint32), order, language.BITS)[0])
        out[order, bucket] += n
    return out


def plain_languages(rows):
    """(doc_id, text, lang) -> doc_id: (losses by language), one classifier and one codeword at a time."""
    grams = {i: plain_ngrams(t) for i, t, _ in rows if t is not None}
    taught = [(i, lang) for i, t, lang in rows if t is not None and lang and zlib.crc32(str(i).encode()) % 4 != 2]
    names = sorted({lang for _, lang in taught})
    bits = [(1, *rest) for rest in product((1, -1), repeat=len(names) - 1) if -1 in rest]
    counts = {name: Counter() for name in names}
    for i, lang in taught:
        counts[lang].update(grams[i])
    weights = []
    for bit in bits:
        sides = []
        for side in (1, -1):
            members = [name for name, sign in zip(names, bit) if sign == side]
            own = Counter()
            for name in members:
                own.update(counts[name])
            buckets, smooth = 1 << language.BITS, language.SMOOTHING
            sizes = {o: sum(n for (order, _), n in own.items() if order == o) + smooth * buckets for o in language.ORDERS}
            sides.append(lambda key, own=own, sizes=sizes, smooth=smooth: math.log((own[key] + smooth) / sizes[key[0]]))
        weights.append(sides)

    def margin(own, bit_sides):
        one, zero = bit_sides
        return sum(n * (one(key) - zero(key)) for key, n in own.items()) / max(1, sum(own.values()))

    margins = {i: [margin(own, sides) for sides in weights] for i, own in grams.items()}
    trust = []
    for b, bit in enumerate(bits):
        right = sum(margins[i][b] * bit[names.index(lang)] > 0 for i, lang in taught)
        trust.append(max(right / len(taught) - 0.5, 0.01))
    losses = {}
    for i, own in margins.items():
        losses[i] = [
            sum(t * math.log1p(math.exp(-m * bit[k])) for t, m, bit in zip(trust, own, bits)) / sum(trust) for k in range(len(names))
        ]
    return names, losses


def test_language_query_against_a_plain_decoder(spark, corpus):
    """Every n-gram, every classifier and every codeword, one by one, over the whole table."""
    rows = [(r.doc_id, r.text, r.lang) for r in corpus(0.001).collect()]
    names, losses = plain_languages(rows)
    found = {r.doc_id: r for r in queries.op9_language(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(rows)
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
            continue
        own = losses[i]
        score = 1 / sum(math.exp(-8 * (x - min(own))) for x in own)
        second = sorted(own)[1]
        assert found[i].score == pytest.approx(score, rel=1e-4)
        assert found[i].lang_pred == names[own.index(min(own))] or second - min(own) < 1e-4


@pytest.mark.parametrize("chars", [1, 2, 3, 7, 64])
def test_long_texts_are_added_up_by_stretches(monkeypatch, chars):
    """Borders inside of n-grams, letters of every plane, blanks only, the empty text."""
    counts = np.random.default_rng(1).integers(0, 9, (3, len(language.ORDERS), 1 << language.BITS))
    model = language.Model(["a", "b", "c"], counts)
    texts = ["", " ", "x", "some text", "ünd  mehr 12", "a\n\nb", "z" * 50, "日本 😀 語", "İstanbul ß"]
    whole = model.margins(texts)
    monkeypatch.setattr(language, "AT_ONCE", chars)
    assert np.allclose(model.margins(texts), whole)


def test_training_counts_long_texts_whole(documents, monkeypatch):
    rows = [(i, f"les mots {i} " * (i % 4 + 1), "fr") for i in range(12)] + [(i, f"the words {i} " * 3, "en") for i in range(20, 32)]
    monkeypatch.setattr(language, "ngram_stretches", None)
    whole = language.train(documents(rows)).weights
    monkeypatch.undo()
    monkeypatch.setattr(language, "AT_ONCE", 5)
    read = documents(rows).select("lang", "text").toArrow().to_batches()
    counted = list(language._counted(iter(read)))
    total = language._summed((x, c) for b in counted for x, c in zip(b.column("lang").to_pylist(), b.column("counts").to_pylist()))
    assert np.array_equal(language.Model(["en", "fr"], np.stack([total["en"], total["fr"]])).weights, whole)


def test_a_text_of_twenty_million_letters_takes_bounded_memory():
    code = """
import resource, numpy as np
from outletscope.llm import language
model = language.Model(list("abcd"), np.ones((4, 2, 1 << language.BITS), np.int64))
model.margins(["warm up"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
model.margins(["some words " * 2_000_000])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout)
    assert grown < 250, f"{grown} MB for 22 MB of text"


# --- toxicity


def places(text, pattern):
    at = text.find(pattern)
    while at >= 0:
        yield at, at + len(pattern)
        at = text.find(pattern, at + 1)


def plain_score(lexicon, text):
    """Each term and each exception searched by itself."""
    if not lexicon.trained:
        return 0.0
    plain = toxicity.folded(text)
    shields = [span for phrase in lexicon.exceptions for span in places(plain, phrase)]
    longest = {}
    for term in lexicon.terms:
        for start, end in places(plain, term):
            if not any(a <= start and end <= b for a, b in shields) and end > longest.get(start, (0, ""))[0]:
                longest[start] = (end, term)
    total = sum(lexicon.terms[t] for _, t in longest.values())
    words = max(1, len(plain.split()))
    bias, by_total, by_density = lexicon.curve
    return 1 / (1 + math.exp(-(bias + by_total * math.log1p(total) + by_density * math.log1p(100 * total / words))))


def test_toxicity_query_against_a_plain_scan(spark, corpus):
    docs, labels = corpus(0.01), corpus(0.01, "labels")
    lexicon = toxicity.learn(docs.where(~held_out()), labels)
    assert lexicon.terms and lexicon.trained
    found = {r.doc_id: r for r in queries.op10_toxicity(spark, SF).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    for r in rows:
        assert found[r.doc_id].score == pytest.approx(plain_score(lexicon, r.text), abs=1e-9)
        assert found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_nested_terms_and_shields_against_a_plain_scan():
    lexicon = toxicity.Lexicon(
        {" idio": 1.0, " idiot": 3.0, " idiot ": 4.0, " scum ": 2.0, " scumm": 1.5},
        frozenset({" village idiot ", " idiot box ", " scum off "}),
        (-2.0, 2.0, 0.5),
        trained=True,
    )
    for text in ("idiot", "village idiot", "village idiot box", "idiotic scum", "scummy scum off idiot", "", None, "1D1OT sсum " * 50):
        assert lexicon.score(text) == pytest.approx(plain_score(lexicon, text))


def test_evidence_against_plain_counts(corpus):
    """Documents that hold each candidate, and which candidates have evidence enough, counted one document at a time."""
    docs, labels = corpus(0.01), corpus(0.01, "labels")
    sample = toxicity._documents(docs.where(~held_out()), labels, toxicity.TRAIN_ROWS)
    rows = sample.select("text", (F.col("toxic") > 0).alias("toxic")).collect()
    sizes = [sum(r.toxic for r in rows), sum(not r.toxic for r in rows)]
    found, number = toxicity._telling(sample, sizes)
    counts = {}
    for r in rows:
        for word in set(toxicity.folded(r.text).split()):
            for pattern in {f" {word[:n]}" for n in range(4, 11) if n <= len(word)} | ({f" {word} "} if 3 <= len(word) <= 20 else set()):
                counts.setdefault(pattern, [set(), set()])[not r.toxic].add(id(r))
    counts = {t: (len(a), len(b)) for t, (a, b) in counts.items()}
    weight = {t: math.log((a + 0.5) / (sizes[0] + 1)) - math.log((b + 0.5) / (sizes[1] + 1)) for t, (a, b) in counts.items()}
    known = {t for t, (a, _) in counts.items() if a >= toxicity.SUPPORT and weight[t] >= toxicity.LEAST_WEIGHT}
    chance, bound = sizes[0] / sum(sizes), toxicity._bound(len(known))
    assert number == len(known)
    assert found == {t: counts[t] for t in known if toxicity._evidence(*counts[t], chance) >= bound - 1e-6}
