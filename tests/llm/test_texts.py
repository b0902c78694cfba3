"""Tokens, shards, search, language, toxicity, mixing and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from outletscope.llm.ngrams import hashed
from outletscope.llm import language, mixing, pieces, queries, sharding, simhash, token_counts, topk, toxicity
from tests.llm.conftest import LINE, LONG, ODD

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
CODEC = pieces.Codec(pieces.VOCABULARY)


def ids(texts):
    return [np.frombuffer(x, np.int32).tolist() for x in CODEC.encode(texts)]


def test_pieces_equal_the_library(corpus):
    texts = [r.text for r in corpus(0.001).collect()] + [t for _, t, _ in ODD if t is not None]
    texts += ["", " ", "a  b", "  lead", "tab\there\n\nx ", "<s> </s> <0x41> <unk>", "x" * 5000, "=" * 333, "日本語" * 90, "\n" * 70]
    assert ids(texts) == [LIBRARY.encode(t) if t else [] for t in texts]
    assert [CODEC.decode(np.array(i)) for i in ids(texts)] == [t.replace("▁", " ") for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aehinorst the▁  \n\té日😀\x00==--"), max_size=150), max_size=5))
def test_pieces_of_random_texts(texts):
    assert ids(texts) == [LIBRARY.encode(t) if t else [] for t in texts]


def test_frequent_words_stay_in_a_full_memory(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 8)
    codec, learned = pieces.Codec(pieces.VOCABULARY), []
    learn = codec._learn
    monkeypatch.setattr(codec, "_learn", lambda words: learned.extend(words) or learn(words))
    for i in range(12):
        texts = [f"the ring of no{i}", f"of the x{i} " + "y" * 80]
        assert [np.frombuffer(x, np.int32).tolist() for x in codec.encode(texts)] == [LIBRARY.encode(t) for t in texts]
        assert max(len(codec.known), len(codec.older)) <= 8
    assert [learned.count(w) for w in ("▁the", "▁of", "▁ring")] == [1, 1, 1]


def test_long_words_use_overlapping_stretches(monkeypatch):
    monkeypatch.setattr(pieces, "INDEXED", 50)
    text = "".join(random.Random(4).choices("theandinger", k=700))
    assert ids([text + "q"]) == [LIBRARY.encode(text + "q")]


def test_pieces_of_odd_documents(documents):
    rows = pieces.encoded(documents()).collect()
    assert len(rows) == len(ODD)
    assert [(r.n_tokens, r.token_ids) for r in rows if r.doc_id == 1] == [(None, None)]
    assert [(r.n_tokens, r.token_ids) for r in rows if r.doc_id == 2] == [(0, [])]
    assert all(r.round_trip for r in rows if r.n_tokens is not None)
    back = pieces.decoded(pieces.encoded(documents())).collect()
    assert sorted(repr((r.doc_id, r.text)) for r in back) == sorted(repr((i, t and t.replace("▁", " "))) for i, t, _ in ODD)
    assert pieces.encoded(documents([])).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens_byte_by_byte(documents, corpus, rule):
    encoder = token_counts.Encoder(token_counts.VOCABULARY)
    docs = documents([(i, t, None) for i, t, _ in ODD if i != 10 and t != LONG] + [(100, "one\n\n\n two\r\n", None), (101, "é\n\n日本\n", None)])
    rows = token_counts.section_tokens(docs, rule).collect()
    for doc_id, text in {(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None}:
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.section)
        own = own[:: 2] if doc_id == 12 else own
        raw = (text or "").encode()
        section_of = np.cumsum([0, *[b == 10 for b in raw]])[: len(raw)]
        counts = np.zeros(len(own))
        start = 0
        for end in encoder.ends(text or ""):
            owned = section_of[start:end]
            if rule == "share":
                for s in owned:
                    counts[s] += 1 / len(owned)
            else:
                counts[owned[0] if rule == "first" else max(sorted(set(owned)), key=lambda s: (list(owned).count(s), -s))] += 1
            start = end
        assert [r.tokens for r in own] == pytest.approx(counts.tolist())
        assert sum(r.n_chars for r in own) == len(text or "") and {r.doc_tokens for r in own} == {len(encoder.ends(text or ""))}
    with pytest.raises(ValueError):
        token_counts.section_tokens(docs, "none")


def test_section_tokens_add_up(spark):
    rows = queries.op2_section_tokens(spark, "/root/testdata/sf0.001").collect()
    sums = {}
    for r in rows:
        sums.setdefault((r.doc_id, r.doc_tokens), []).append(r.tokens)
    assert all(total == sum(tokens) for (_, total), tokens in sums.items()) and len(sums) == 200


def plain_shards(rows, shards):
    """rows: (doc_id, text). What the operator returns, in order of id, size and checksum."""
    marked = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    marked.sort(key=lambda r: (r[0] is not None, r))
    total, before, slots, out = sum(r[1] for r in marked), 0, {}, []
    for row in marked:
        shard = before * shards // total
        slots[shard] = slots.get(shard, -1) + 1
        out.append((*row, shard, slots[shard]))
        before += row[1]
    return out


def test_shards_against_brute_force(spark, corpus, documents):
    found = queries.op3_byte_shards(spark, "/root/testdata/sf0.01").collect()
    rows = [(r.doc_id, r.text) for r in corpus(0.01).collect()]
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in found) == plain_shards(rows, 16)
    sizes = np.bincount([r.shard for r in found], [r.size for r in found], minlength=16)
    assert sizes.max() - sizes.min() <= 2 * max(r.size for r in found)
    odd = sharding.byte_shards(documents(), 5).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in odd), key=repr) == sorted(plain_shards([r[:2] for r in ODD], 5), key=repr)
    assert sharding.byte_shards(documents([])).count() == 0


def plain_top(vectors, query_ids, k):
    out = set()
    for q, own in sorted({(i, tuple(v)) for i, v in vectors if i in query_ids}):
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in {(i, tuple(v)) for i, v in vectors} if i != q and len(v) == len(own))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_top_k_of_random_vectors(spark):
    draw = random.Random(8)
    vectors = [(i, [draw.choice([draw.randint(-400, 400), 0, 7]) for _ in range(9)]) for i in range(400)]
    vectors += [(1000 + i, vectors[i % 3][1]) for i in range(40)]  # ties
    vectors += [(2000, [1, 2]), (2100, [3, 4]), (2200, [0, 0]), (5, vectors[5][1])]
    frame = spark.createDataFrame(vectors, "id long, vector array<long>")
    asked = frame.where("id % 100 = 0")
    for slices, rows in ((5, 16384), (1, 64), (12, 100)):
        found = topk.top_k(frame, asked, 10, slices, rows).collect()
        assert {tuple(r) for r in found} == plain_top(vectors, {i for i, _ in vectors if i % 100 == 0}, 10)
        assert len(found) == len(set(found))


def test_quantised_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [1.0, -inf]), (5, []), (6, [0.0009, -0.0001])]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>")
    found = {r.id: r.v for r in frame.select("id", topk.quantised(frame.embedding).alias("v")).collect()}
    assert found == {0: [512, -256], 1: None, 2: None, 3: None, 4: None, 5: None, 6: [0, -1]}
    assert topk.top_k(*[frame.select("id", topk.quantised(frame.embedding).alias("vector")).where("id < 0")] * 2).count() == 0


def test_bit_sliced_sum_and_threshold():
    draw = np.random.default_rng(3)
    bitmaps = draw.integers(0, 1 << 63, (40, 3), dtype=np.uint64)
    weights = draw.integers(0, 5, 40)
    sums = topk.added({int(w): [b for b, x in zip(bitmaps, weights) if x == w] for w in set(weights)})
    bits = lambda b: np.unpackbits(b.view(np.uint8), bitorder="little").astype(int)
    plain = sum(bits(b) << w for b, w in zip(bitmaps, weights))
    assert (sum(bits(s) << i for i, s in enumerate(sums)) == plain).all()
    everyone = np.full(3, ~np.uint64(0))
    assert topk.kth(sums, everyone, 11) == sorted(plain)[-11]
    assert (bits(topk.at_least(sums, 150)) == (plain >= 150)).all()


def test_codewords():
    for languages in (1, 2, 4, 6, 7, 30):
        code = language.codewords(languages)
        assert len({tuple(r) for r in code}) == (languages if languages > 1 else 1) and len(code) == languages
        assert all(abs(c.sum()) < languages for c in code.T)


def test_language_of_held_out_documents(spark, corpus):
    rows = queries.op9_language(spark, "/root/testdata/sf0.1").collect()
    truth = {r.doc_id: r.lang for r in corpus(0.1).collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_documents(documents):
    rows = [(i, t, lang) for i, t, lang in ODD if t != LONG] + [(i, f"the words and the {i} others", "en") for i in range(50, 60)]
    rows += [(i, f"les mots et aussi une {i} pour", "fr") for i in range(60, 70)]
    found = {r.doc_id: r for r in language.language_of(documents(rows)).collect()}
    assert (found[1].lang_pred, found[1].score) == ("und", 0.0) and found[2].lang_pred == found[3].lang_pred == found[11].lang_pred == "und"
    assert found[52].lang_pred == "en" and found[63].lang_pred == "fr"
    untaught = language.language_of(documents([(1, "some text", None), (2, None, "en")])).collect()
    assert {r.lang_pred for r in untaught} == {"und"}
    one = language.language_of(documents([(i, "some text", "xx") for i in range(8)])).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("xx", 1.0)}
    assert language.language_of(documents([])).count() == 0


def test_predictions_do_not_depend_on_neighbours():
    counts = np.random.default_rng(0).integers(0, 9, (3, len(language.ORDERS), 1 << language.BITS))
    model = language.Model(["a", "b", "c"], counts)
    texts = ["x", "some text", "ünd mehr", "a\n\nb", "z" * 50]
    together = model.margins(texts)
    assert np.allclose(together, np.concatenate([model.margins([t]) for t in texts]))


def test_toxicity_of_held_out_documents(spark, corpus):
    rows = queries.op10_toxicity(spark, "/root/testdata/sf0.1").collect()
    truth = {r.doc_id: r.toxic for r in corpus(0.1, "labels").collect()}
    assert len(rows) == corpus(0.1).count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p for t, p in held if t == 1]) > 0.85
    assert np.mean([p for t, p in held if t == 0]) < 0.03


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot": 3.0, " scum ": 2.0}, frozenset({" village idiot "}), (-2.0, 2.0, 0.5), trained=True)
    assert toxicity.folded("An 1D1OT, а ѕсum! in 2024") == " an idiot a scum in "
    assert [p for _, p in lexicon.matches(toxicity.folded("idiotic scum, scummy"))] == [" idiot", " scum "]
    assert lexicon.matches(toxicity.folded("the village idiot of videos")) == []
    assert lexicon.score("idiot") > lexicon.score("idiot " + "word " * 200) > lexicon.score("word") == lexicon.score(None)


def words(seed):
    """Words that make a document unlike others."""
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("aeinorst", k=6)) for _ in range(12))


def test_toxicity_of_odd_documents(documents, labels):
    rows = list(ODD) + [(i, f"number {i} is plain and fine", "en") for i in range(200, 240)] + [(i, f"you {words(i)} badword {words(i)}", "en") for i in range(240, 270)]
    marks = labels([(i, 1, int(i >= 240)) for i in range(200, 270)] + [(None, 1, 1), (3, 1, None), (200, 1, 0)])
    found = {r.row.doc_id: r for r in toxicity.toxicity(documents(rows), marks).collect()}
    assert found[250].score > 0.9 > 0.1 > found[210].score
    assert found[1].score == found[2].score and set(found[250].row.asDict()) == set(documents().columns)
    untaught = toxicity.toxicity(documents(), labels([])).collect()
    assert len(untaught) == len(ODD) and {r.score for r in untaught} == {0.0}
    assert toxicity.toxicity(documents([]), marks).count() == 0


def test_only_copies_are_left_out_of_the_evidence(documents, labels):
    """Different documents of common words all teach; copies teach once, among the others as well."""
    draw = random.Random(11)
    common = ["".join(draw.choices("abcdefghiklmnoprstuw", k=6)) for _ in range(60)]
    slurs = [f"{c}{c}slurry" for c in "bcdfghjklm"]

    def prose():
        return " ".join(draw.choices(common, k=40))

    rows = [(i, f"{prose()} {slurs[i % 10]} {prose()}", "en") for i in range(60)]
    quoted = f"{prose()} bbslurry {prose()}"
    rows += [(100 + i, f"{quoted} copy{i}", "en") for i in range(200)]
    rows += [(1000 + i, f"{prose()} {prose()}", "en") for i in range(500)]
    lexicon = toxicity.learn(documents(rows), labels([(i, 1, int(i < 60)) for i, _, _ in rows]))
    text = " " + " ".join(slurs) + " "
    assert len(lexicon.matches(text)) == len(slurs)


def test_rare_toxic_terms_are_not_cut_by_frequency(documents, labels):
    """More frequent words than were once counted, all of them harmless, and a rare term that is purely toxic."""
    draw = random.Random(12)
    harmless = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(5_000)]
    rows = [(i, " ".join(draw.sample(harmless, 3_000)) + " rareslur" * (i < 6), "en") for i in range(84)]
    lexicon = toxicity.learn(documents(rows), labels([(i, 1, int(i < 24)) for i, _, _ in rows]))
    assert lexicon.matches(" a rareslur here ")


def test_labels_of_absent_documents_take_no_place_in_the_samples(documents, labels, spark):
    rows = [(i, f"number {words(i)}", "en") for i in range(10)]
    marks = labels([(i, 1, i % 2) for i in range(1_000)])
    assert toxicity._documents(documents(rows), marks, 10).count() == 10
    model = mixing.train(documents(rows), marks.selectExpr("doc_id", "if(toxic > 0, 'a', 'b') AS domain"), ["a", "b"], rows=10)
    assert model.weights.any()


def test_rates_against_a_plain_solver(spark):
    draw = np.random.default_rng(6)
    n, k = 300, 3
    tokens = draw.integers(0, 900, n)
    posterior = draw.dirichlet(np.ones(k) * 0.4, n)
    rows = [(i, int(t), *map(float, p)) for i, (t, p) in enumerate(zip(tokens, posterior))]
    members = spark.createDataFrame(rows, "doc_id long, tokens long, p_0 double, p_1 double, p_2 double")
    have = tokens @ posterior
    goal = have.sum() * np.array([0.6, 0.3, 0.1])
    found = np.array([r.rate for r in mixing.rates(members, goal.tolist()).orderBy("doc_id").collect()])
    assert (found >= 0).all() and np.abs((found * tokens) @ posterior - goal).max() <= 1e-4 * goal.sum()
    # more of two domains, with every rate at least 1, where all rates begin
    goal = have * np.array([1.0, 1.25, 1.1])
    found = np.array([r.rate for r in mixing.rates(members, goal.tolist(), floor=1.0).orderBy("doc_id").collect()])
    assert found.min() >= 1 and found.max() > 1 and np.abs((found * tokens) @ posterior - goal).max() <= 0.01 * goal.sum()
    # out of reach: no rate below 1 may be used, so the least squares are the plain ones
    floored = mixing.rates(members, (0.5 * have).tolist(), floor=1.0)
    assert {r.rate for r in floored.collect()} == {1.0}
    with pytest.raises(ValueError):
        mixing.rates(members, goal.tolist(), floor=-1.0)


def least_distance(a, b):
    """The least |a x - b| over x >= 0, by the active-set method of Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(1000):
        push = np.where(free, -np.inf, a.T @ (b - a @ x))
        if push.max() <= 1e-12 * np.abs(a).max():
            break
        free[push.argmax()] = True
        while True:
            z = np.zeros(len(x))
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if z[free].min() > 0:
                break
            worse = free & (z <= 0)
            x += (x[worse] / (x[worse] - z[worse])).min() * (z - x)
            free &= x > 1e-14
            x[~free] = 0
        x = z
    return float(np.linalg.norm(a @ x - b))


@pytest.mark.parametrize("shares, floor, softness", [((0.86, 0.14), 1.0, 0.4), ((0.86, 0.14), 1.0, 2.0), (None, 0.0, 0.4), (None, 0.0, 2.0)])
def test_rates_reach_the_least_distance(spark, shares, floor, softness):
    """Long and short documents, soft posteriors, many rates on the floor; some of the targets are out of reach."""
    draw = np.random.default_rng(5)
    n, k = 2000, len(shares or range(8))
    tokens = np.floor(draw.lognormal(5, 1.5, n))
    posterior = draw.dirichlet(np.array(shares or draw.dirichlet(np.ones(k))) * softness * k + 0.02, n)
    have = tokens @ posterior
    goal = np.array([0.1, 0.9]) if shares else draw.dirichlet(np.ones(k))
    goal = goal * max(have.sum(), *(floor * have / goal))
    columns = ", ".join(f"p_{i} double" for i in range(k))
    members = spark.createDataFrame([(int(t), *map(float, p)) for t, p in zip(tokens, posterior)], f"tokens long, {columns}")
    rows = mixing.rates(members, goal.tolist(), floor).collect()
    totals = sum(r.rate * r.tokens * np.array(r[1 : k + 1]) for r in rows)
    best = least_distance((tokens[:, None] * posterior).T / goal.sum(), (goal - floor * have) / goal.sum())
    assert min(r.rate for r in rows) >= floor
    assert np.linalg.norm(totals - goal) / goal.sum() <= best + 2e-4


def test_projected_gradient_alone_meets_the_targets(spark, monkeypatch):
    """Posteriors as sharp as a classifier's: the gradient needs no help, and its rates equal plain numpy steps."""
    monkeypatch.setattr(mixing, "_newton", lambda *_: pytest.fail("Newton steps"))
    draw = np.random.default_rng(4)
    tokens = np.floor(draw.lognormal(5, 1, 500))
    posterior = draw.dirichlet(np.ones(4) * 0.1, 500)
    goal = np.array([0.4, 0.3, 0.2, 0.1]) * tokens.sum()
    rows = [(int(t), *map(float, p)) for t, p in zip(tokens, posterior)]
    members = spark.createDataFrame(rows, "tokens long, p_0 double, p_1 double, p_2 double, p_3 double")
    found = np.array([r.rate for r in mixing.rates(members, goal.tolist()).collect()])
    assert (found >= 0).all() and np.abs((found * tokens) @ posterior - goal).max() <= 1e-4 * goal.sum()
    first = mixing.Descent(0.0, 1.0, [(np.array([0.5, 0.0, -0.5, 2.0]), 0.0)])
    assert np.allclose(first.rates(posterior)[0], np.maximum(0, 1 - posterior @ [0.5, 0.0, -0.5, 2.0]))


def test_posteriors_against_a_plain_softmax(spark, documents):
    """What Spark returns is exp(score) over its sum, scores being products of plain features and weights."""
    draw = np.random.default_rng(8)
    model = mixing.Classifier(["a", "b", "c"], draw.normal(size=(mixing.BUCKETS + mixing.SHAPES, 3)))
    for r in mixing.posteriors(documents([x for x in ODD if len(x[1] or "") < 1_000]), model).collect():
        assert abs(r.p_0 + r.p_1 + r.p_2 - 1) < 1e-9
    texts = {1: "ab ab", 2: "Some Words, in a row!", 3: "zz"}
    found = mixing.posteriors(documents([(i, t, "en") for i, t in texts.items()]), model).collect()
    for r in found:
        text = f" {texts[r.doc_id]} "
        row = np.zeros(mixing.BUCKETS + mixing.SHAPES)
        pairs = [text[i : i + 2] for i in range(len(text) - 1)]
        for pair in pairs:
            row[hashed(np.array([ord(c) for c in pair], dtype=np.uint32), 2, mixing.BITS)[0]] += 1
        row = np.sqrt(row / len(pairs))
        row[mixing.BUCKETS :] = mixing.features([texts[r.doc_id]])[0][0, mixing.BUCKETS :]
        scores = [sum(row * model.weights[:, i]) for i in range(3)]
        plain = [np.exp(s) / sum(map(np.exp, scores)) for s in scores]
        assert np.allclose([r.p_0, r.p_1, r.p_2], plain, atol=1e-5)


def test_a_unique_text_of_a_repeated_id_stays(spark, documents):
    """A row whose doc_id also has a copy of another document's text is not dropped for it, and the copy is."""
    original = " ".join(words(i) for i in range(30))
    near = next(
        t for i in range(1000) if 0 < (simhash.fingerprint(t := f"{original} {words(i + 50)[:6]}") ^ simhash.fingerprint(original)).bit_count() <= simhash.RADIUS
    )
    unique = {i: "zz " + " ".join(words(j) for j in range(i * 100, i * 100 + 9)) for i in (7, 8)}
    rows = [(3, original, "en"), (7, original, "en"), (7, unique[7], "en"), (8, near, "en"), (8, unique[8], "en"), (9, near, "en")]
    found = corpus_pipeline.drop_near_copies(spark, documents(rows), "").collect()
    assert sorted((r.doc_id, r.text) for r in found) == [(3, original), (7, unique[7]), (8, unique[8])]


def test_mixture_of_a_corpus(spark):
    rows = queries.op1_mixing(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 10_000 and min(r.rate for r in rows) >= 0
    for read in ("rate", "copies"):
        totals = np.array([sum(r[read] * r.tokens * r[f"p_{name}"] for r in rows) for name in queries.MIX])
        assert np.abs(totals / totals.sum() - np.array(list(queries.MIX.values()))).max() < (0.002 if read == "rate" else 0.01)


def test_mixing_with_a_floor_repeats_the_scarcer_domain(spark, corpus):
    """What the pipeline's stage does: the scarcer domain's documents more than once, none left out."""
    docs, labels = corpus(0.01), corpus(0.01, "labels")
    marks = labels.selectExpr("doc_id", "if(quality > 0, 'high', 'low') AS domain")
    rows = mixing.mixed(docs, marks, {"low": 0.3, "high": 0.7}, floor=1.0).collect()
    totals = np.array([sum(r.rate * r.tokens * r[p] for r in rows) for p in ("p_0", "p_1")])
    assert min(r.copies for r in rows) >= 1 and sum(r.copies for r in rows) > len(rows)
    assert abs(totals[0] / totals.sum() - 0.3) < 0.02


def test_mixing_odd_documents(documents, labels, spark):
    marks = spark.createDataFrame([(6, "a"), (7, "b"), (None, "a"), (9, None), (99, "b"), (8, "c")], "doc_id long, domain string")
    found = mixing.mixed(documents(), marks, {"a": 1.0, "b": 3.0}).collect()
    assert len(found) == len(ODD) and all(r.copies >= 0 for r in found)
    assert {r.tokens for r in found if r.doc_id in (1, 2, 3)} == {0}
    untaught = mixing.mixed(documents(), marks.where("doc_id = 1000"), {"a": 1.0, "b": 1.0}).collect()
    assert {(r.p_0, r.p_1) for r in untaught} == {(0.5, 0.5)}
    assert mixing.mixed(documents([]), marks, {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(documents(), marks, {"a": 0.0})


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_matches_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    columns = sorted(frame.columns)
    result = duck("/root/testdata/sf0.01").execute(queries.ORACLE[name])
    order = [[c[0] for c in result.description].index(c) for c in columns]
    expected = sorted(tuple(row[i] for i in order) for row in result.fetchall())
    assert expected and sorted(tuple(row[c] for c in columns) for row in frame.collect()) == expected


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_of_odd_and_empty_tables(spark, folder, documents, name):
    found = queries.QUERIES[name](spark, folder())
    rows = found.count()
    if name in ("op8_bit_sliced", "op13_hard_negatives"):  # of another table; see test_mining
        assert rows
        return
    assert rows >= len(ODD) if name == "op2_section_tokens" else rows == len(ODD)


@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_empty_tables(spark, folder, name):
    query = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
    assert query(spark, folder([], [], [], [])).count() == 0


def test_pipeline_stages(spark, folder):
    """Each stage against a plain reading of its decisions."""
    rows = list(ODD) + [(i, f"plain {words(3 * i)} document {words(5 * i)}", "en") for i in range(200, 240)]
    rows += [(i, f"{words(i)} badword {words(-i)}", "en") for i in range(240, 270)]
    marks = [(i, int(i % 5 > 0), int(i >= 240)) for i in range(200, 270)]
    path = folder(rows, marks)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        states.append(spark.createDataFrame((made := stage(spark, states[-1], path)).collect(), made.schema))
    columns = [s.columns for s in states]
    assert all(c == docs.columns for c in columns[:-1])
    ids_of = [{r.doc_id for r in s.collect()} for s in states]
    assert ids_of[0] - ids_of[1] == set(range(240, 270))
    assert ids_of[2] == ids_of[1] and {r.text for r in states[2].collect() if r.doc_id == 6} == {"some words of the sixth"}
    assert ids_of[2] - ids_of[3] >= {2, 3, 5} and 4 in ids_of[3] and set(range(200, 240)) <= ids_of[3]
    # the null text without an id is a copy of the first document's; a repeated id keeps its different texts
    assert [r.text for r in states[3].collect() if r.doc_id is None] == [f"{LINE}\nno id"]
    assert sorted(r.text for r in states[3].collect() if r.doc_id == 10) == [f"ten\n{LINE}\r", "ten again, with another text"]
    marks = [simhash.fingerprint(r.text) for r in states[3].collect()]
    assert all((a ^ b).bit_count() > simhash.RADIUS for i, a in enumerate(marks) for b in marks[:i])
    assert ids_of[4] == ids_of[3] and states[4].count() >= states[3].count()
    assert states[5].count() == states[4].count()
    assert sorted(repr(tuple(r)) for r in corpus_pipeline.run(spark, path).collect()) == sorted(repr(tuple(r)) for r in states[5].collect())
