import math
import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gapcast.llm import language, quality, toxicity
from gapcast.llm.tables import held_out



def prose(rng, words, n):
    return " ".join(rng.choices(words, k=n))


@pytest.fixture(scope="module")
def corpus(make_docs, spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("aeioustnrl", k=rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        text, bad, toxic = prose(rng, words, rng.randint(20, 80)), i % 5 == 0, i % 4 == 0
        if bad:
            text = " ".join(w for w in text.split()[:12] for _ in range(6))
        if toxic:
            at = len(text) // 2
            text = text[:at] + f" vile{'abcdefgh'[i % 8]}r you " + text[at:]
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, int(toxic)))
    labels += [(0, None, None), (None, 1, 1), (9999, 1, 1), labels[3]]
    return make_docs([*rows, (1000, None), (1001, ""), (None, rows[1][1]), rows[1], (1002, prose(rng, words, 30_000))]), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int"
    )


def checked(scored, labels, column, threshold):
    """Accuracy on held-out documents; scores lie in 0 to 1 and repeated rows agree."""
    rows = scored.select("doc_id", "score", "rest", held_out(F.col("doc_id"), 4, 2).alias("out")).collect()
    assert len(rows) == 405 and all(0 <= r["score"] <= 1 for r in rows) and {r["rest"] for r in rows} == {"mine"}
    scores = {}
    for r in rows:
        assert scores.setdefault(r["doc_id"], r["score"]) == r["score"]
    assert scores[1000] == scores[1001] and scores[None] == scores[1]
    truth = {r["doc_id"]: r[column] for r in labels.collect() if r[column] is not None}
    tested = [r["doc_id"] for r in rows if r["out"] and r["doc_id"] in truth]
    assert len(tested) > 50
    return np.mean([(scores[i] >= threshold) == (truth[i] == 1) for i in tested])


def test_quality(corpus):
    docs, labels = corpus
    learn = ~held_out(F.col("doc_id"), 4, 2)
    model = quality.fit_quality(docs, labels, learn, vocabulary=1 << 12, dims=32)
    assert checked(quality.score_quality(docs, model), labels, "quality", 0.7) > 0.95
    again = quality.fit_quality(docs.repartition(5), labels, learn, vocabulary=1 << 12, dims=32)
    assert (again.vectors == model.vectors).all() and again.network.temperature == model.network.temperature


def test_toxicity(corpus):
    docs, labels = corpus
    model = toxicity.fit_toxicity(docs, labels, ~held_out(F.col("doc_id"), 4, 2), bits=16, l1=1.0)
    assert checked(toxicity.score_toxicity(docs, model), labels, "toxic", 0.5) > 0.95
    assert 0 < len(model.places) < 2000


def test_without_labels_or_documents(corpus, make_docs):
    docs, labels = corpus
    none = labels.where("doc_id = 9999")
    assert {r["score"] for r in quality.score_quality(docs, quality.fit_quality(docs, none, F.lit(True), dims=8, vocabulary=256)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none, F.lit(True), bits=8)).collect()} == {0.5}
    one = quality.fit_quality(docs, labels.where("quality = 1"), F.lit(True), dims=8, vocabulary=256)
    assert {r["score"] for r in quality.score_quality(docs, one).collect()} == {1.0}
    empty = make_docs([])
    assert quality.score_quality(empty, quality.fit_quality(empty, labels, F.lit(True), dims=8, vocabulary=256)).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels, F.lit(True), bits=8)).count() == 0


def test_context_vectors_equal_brute_force(make_docs):
    texts = ["a b c a", "b", "", "c c a b d e"]
    vectors = quality.context_vectors(make_docs(enumerate(texts)), vocabulary=256, dims=16)
    codes, (places, signs) = quality.Codes(256), quality.index_vectors(256, 16, 17)
    total, count = np.zeros((256, 16)), np.zeros((256, 1))
    for text in texts:
        own = [codes[w.encode()] for w in text.split()]
        for i, c in enumerate(own):
            count[c] += 1
            for j, other in enumerate(own):
                if 1 <= abs(i - j) <= 2:
                    np.add.at(total[c], places[other], signs[other])
    centred = total - count * total.sum(axis=0) / count.sum()
    assert np.allclose(vectors, centred / (np.linalg.norm(centred, axis=1, keepdims=True) + 4), atol=1e-6)


def test_language(make_docs):
    rng = random.Random(2)
    kinds = {"aa": ["the", "and", "with", "shore"], "bb": ["één", "niet", "zijn", "wij"], "cc": ["он", "она", "были", "здесь"]}
    rows = [(i, prose(rng, kinds[k := "abc"[i % 3] * 2], rng.randint(5, 30)), k) for i in range(150)]
    rows += [(200, None, "aa"), (201, "12 .. 3", "bb"), (202, "", None), (203, "The AND shore", None), (None, "был здесь", None), rows[0]]
    rows += [(204, "with and the shore " * 20_000, None)]
    docs = make_docs(rows, "doc_id long, text string, lang string")
    learn = ~held_out(F.col("doc_id"), 5, 0)
    model = language.fit_languages(docs, learn)
    assert model.languages == ["aa", "bb", "cc"] and np.allclose(np.linalg.norm(model.prototypes, axis=1), 1)
    found = language.predict_language(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    got = {r["doc_id"]: r["lang_pred"] for r in found}
    assert all(got[i] == lang for i, _, lang in rows if i is not None and i < 200)
    assert (got[200], got[201], got[202], got[203], got[204], got[None]) == ("und", "und", "und", "aa", "aa", "cc")
    again = language.fit_languages(docs.repartition(4), learn)
    assert (again.prototypes == model.prototypes).all()
    none = language.fit_languages(docs.where("lang IS NULL"), learn)
    assert {r["lang_pred"] for r in language.predict_language(docs, none).collect()} == {"und"}
    assert language.predict_language(docs.limit(0), model).count() == 0


def test_bundles_equal_the_definition():
    space = language.Hypervectors(64, 29)
    text = "Ab, cd  é!"
    letters = [ord(c) for c in " ab cd é "]
    expected = sum(space.gram(tuple(letters[i : i + 3])) for i in range(len(letters) - 2))
    found, lettered = space.bundles([text, None, "..", "x"])
    assert (found[0] == expected).all() and lettered.tolist() == [True, False, False, True] and not found[1:3].any()


def plain_features(text, bits):
    """Words, their stems and pairs with gaps of one and two, one by one, in whole numbers."""
    mask, out = (1 << 64) - 1, []
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    codes = [xxhash.xxh64_intdigest(w) for w in words]
    out += codes
    for n in (4, 5):
        out += [xxhash.xxh64_intdigest(w.decode("utf-8", "replace")[:n].encode(), n) for w in words]
    for gap in (1, 2):
        for a, b in zip(codes, codes[gap:]):
            mixed = (a * 0x9E3779B97F4A7C15 + b * (2 * gap + 1)) & mask
            out.append((mixed ^ (mixed >> 31)) * 0xBF58476D1CE4E5B9 & mask)
    return sorted(h >> (64 - bits) for h in out)


def test_toxicity_features_equal_the_definition():
    texts = [None, "", "One", "a b c d", "Naïve ÉTÉ 12x, the the the", "x" * 5000, "word " * 400]
    doc, gram = toxicity.features(texts, toxicity._Hashes(), 20)
    for i, text in enumerate(texts):
        assert sorted(gram[doc == i].tolist()) == plain_features(text, 20)


def test_ftrl_equals_the_plain_update_weight_by_weight():
    """The published per-coordinate update, one coordinate at a time."""
    rng = random.Random(4)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.8, 0.05
    ftrl = toxicity.Ftrl(6, alpha, beta, l1, l2)
    z, n, bias = [0.0] * 65, [0.0] * 65, 64

    def weight(i):
        penalty = 0.0 if i == bias else l1
        if abs(z[i]) <= penalty:
            return 0.0
        return -(z[i] - math.copysign(penalty, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(300):
        at = sorted(rng.sample(range(64), rng.randint(0, 9)))
        label = float(3 in at or rng.random() < 0.1)
        ftrl.learn(np.array(at, np.int64), label)
        own = {i: weight(i) for i in [*at, bias]}
        g = 1 / (1 + math.exp(-sum(own.values()))) - label
        for i, w in own.items():
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i], n[i] = z[i] + g - sigma * w, n[i] + g * g
    model = ftrl.model()
    expected = {i: weight(i) for i in range(64) if weight(i)}
    assert dict(zip(model.places.tolist(), model.weights.tolist())) == pytest.approx(expected)
    assert model.intercept == pytest.approx(weight(bias)) and 0 < len(expected) < 64


def test_toxicity_scores_equal_the_sum_of_distinct_features(make_docs):
    rng = np.random.default_rng(2)
    places = np.sort(rng.choice(1 << 10, 300, replace=False))
    model = toxicity.ToxicityModel(places, rng.normal(size=300), -0.3, 10)
    texts = ["a b a b", "other words here", None, "", "z " * 3000]
    known = dict(zip(places.tolist(), model.weights.tolist()))
    for row in toxicity.score_toxicity(make_docs(list(enumerate(texts))), model).collect():
        total = model.intercept + sum(known.get(f, 0.0) for f in set(plain_features(texts[row["doc_id"]], 10)))
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-total)))


def test_bundles_of_many_short_texts_stay_small():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=60)) for _ in range(4000)]
    space = language.Hypervectors(64, 1)
    tracemalloc.start()
    found, lettered = space.bundles(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and lettered.all()
    some = [0, 2047, 2048, 3999]
    assert (np.concatenate([language.Hypervectors(64, 1).bundles([texts[i]])[0] for i in some]) == found[some]).all()
