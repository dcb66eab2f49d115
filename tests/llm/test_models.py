import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import langid, quality_classifier, queries, toxicity
from textloom.llm.common import fold

SF = "/root/testdata/sf0.01"


def held_out(spark, got, column, sf=SF):
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max(column).alias("y"))
    return got.where("held_out").join(labels, "doc_id").toPandas()


def test_noisy_or_finds_words_and_sentences(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    rows = []
    for i in range(400):
        sentences = [" ".join(word() for _ in range(8)) for _ in range(6)]
        if i % 4 == 0:
            sentences[draw.randrange(6)] += draw.choice([" grumble", " gnarlstuff", " gnarlings"])
        rows.append((i, ". ".join(sentences) + ".", int(i % 4 == 0)))
    model = toxicity.fit_texts([r[1] for r in rows[:300]], [r[2] for r in rows[:300]])
    s = model.documents([r[1] for r in rows[300:]])
    assert ((s >= 0.5) == np.array([r[2] for r in rows[300:]], bool)).mean() > 0.97
    assert model.documents(["quiet words. " * 3000 + "grumble"])[0] > 0.9 > 0.5 > model.documents(["quiet words. " * 1000])[0]
    docs = spark.createDataFrame([(1, "All fine here. What a grumble, you. Fine again."), (2, None)], "doc_id long, text string")
    found = toxicity.offending(docs, model).collect()
    assert [(r["doc_id"], r["sentence"].strip()) for r in found] == [(1, "What a grumble, you.")]
    assert docs.first()["text"][found[0]["start"] : found[0]["end"]] == found[0]["sentence"]


def test_toxicity_on_held_out_documents(spark):
    """About a tenth of the toxic labels stand on texts without a sign of it, so recall can't be whole."""
    sf = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, sf)
    y = held_out(spark, got, "toxic", sf)
    assert got.count() == 10_000 and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert y[y["y"] == 1]["predicted"].mean() > 0.85 and y[y["predicted"] == 1]["y"].mean() > 0.9


def test_quality_on_held_out_documents(spark):
    got = queries.op6_quality_classifier(spark, SF)
    y = held_out(spark, got, "quality")
    assert got.count() == 1000 and y[y["y"] == 1]["predicted"].mean() > 0.9 and y[y["y"] == 0]["predicted"].mean() < 0.2
    assert abs(y["score"].mean() - y["y"].mean()) < 0.1


def test_language_on_held_out_documents(spark):
    got = queries.op8_language_id(spark, SF)
    y = got.where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert got.count() == 1000 and (y["lang_pred"] == y["lang"]).mean() > 0.98


def test_kernel_scores_equal_the_landmark_form(monkeypatch):
    """Scores by the kernel's definition on sets of n-grams, landmark by landmark, and the blocked products that replace it."""
    import unicodedata

    monkeypatch.setattr(langid, "COLUMNS", 37)
    texts = ["the cat sat on the mat", "le chat est sur le tapis", "a dog in the fog", "un chien dans le jardin", "the end of the day", "la fin du jour"]
    names = ["en", "fr"] * 3
    model = langid.fit_texts(texts, names, landmarks=4)
    assert model.predict(["the dog sat", "le chien est", "123 !?", "", None])[0] == ["en", "fr", "und", "und", "und"]

    def grams(text):
        kept = "".join(c.lower() if unicodedata.category(c).startswith("L") else " " for c in f" {text} ")
        line = " " + " ".join(kept.split()) + " "
        return {line[i : i + n] for n in (2, 3, 4) for i in range(len(line) - n + 1)}

    landmarks = [grams(t) for t in texts[:4]]
    shared = {g for x in landmarks for g in x if sum(g in y for y in landmarks) > 1}
    kernel = lambda a, b: len(a & b & shared) / np.sqrt(max(len(a & shared), 1) * max(len(b & shared), 1))
    own = np.array([[kernel(a, b) for b in landmarks] for a in landmarks])
    value, vector = np.linalg.eigh(own)
    root = (vector / np.sqrt(np.maximum(value, 1e-6 * value.max()))) @ vector.T
    x = np.array([[kernel(grams(t), b) for b in landmarks] for t in texts]) @ root
    y = np.array([[1.0, -1.0] if n == "en" else [-1.0, 1.0] for n in names])
    solved = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + langid.RIDGE * np.eye(4), (x - x.mean(0)).T @ (y - y.mean(0)))
    for text in ["the dog sat", "un chien est la", "zzz", *texts]:
        want = (np.array([kernel(grams(text), b) for b in landmarks]) @ root - x.mean(0)) @ solved + y.mean(0)
        assert np.allclose(model.margins(model.hits([text])[0])[0], want, atol=1e-4)


def plain_noisy_or(model, text):
    """The chance of a document and of its sentences by the definition: each sentence over one without weight."""
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    quiet, each = 1.0, []
    for s in re.split(r"[.!?\n]", text.lower()):
        z = sum(model.weights.get(f, 0) for w in set(re.findall(r"\w+", s)) for f in [w, *(w[:k] + "-" for k in range(4, min(9, len(w))))])
        ratio = (1 - sigmoid(model.bias + z)) / (1 - sigmoid(model.bias))
        quiet *= ratio
        each.append(1 - ratio)
    return 1 - quiet, each


def test_noisy_or_equals_a_plain_one():
    model = toxicity.Model({"idiot": 5.0, "idio-": 2.0, "rude": 3.0, "fool": 9.0}, -6.0)
    draw = random.Random(3)
    words = ["idiot", "idiom", "rude", "fool", "fine", "day", "Rude", "x", "7"]
    for _ in range(200):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", ", ", ". ", "!\n", "? ", "."]) for _ in range(draw.randint(0, 30)))
        want, each = plain_noisy_or(model, text)
        (whole, located), = model.located([text])
        assert abs(whole - want) < 1e-9 and abs(model.documents([text])[0] - whole) < 1e-12
        assert {s for s, p in located if p >= 0.5} == {i for i, p in enumerate(each) if p >= 0.5}


def test_the_bias_is_learned():
    texts = [". ".join(["calm words here"] * 5 + (["you grumble"] if i % 3 == 0 else [])) for i in range(120)]
    model = toxicity.fit_texts(texts, [int(i % 3 == 0) for i in range(120)], start=-4.0)
    assert model.bias < -4.0
    assert ((model.documents(texts) >= 0.5) == np.array([i % 3 == 0 for i in range(120)])).all()


def test_quality_scores_equal_a_plain_network():
    draw = random.Random(5)
    good = lambda: " ".join(draw.choice(["the", "river", "runs", "past", "old", "mills", "and", "towns"]) for _ in range(30)) + "."
    bad = lambda: " ".join(draw.choice(["BUY", "now", "$$$", "click", "here", "!!!", "win", "7777"]) for _ in range(30))
    texts = [good() if i % 2 else bad() for i in range(80)]
    model = quality_classifier.fit_texts(texts, [i % 2 for i in range(80)], epochs=60)
    for text in [*texts[:10], "", "the Unknownword 42 ???"]:
        pooled, n = np.zeros(model.inner.shape[1]), 0
        for token in re.findall(r"\w+|[^\w\s]+", text):
            row = model.ids.get(token, model.ids.get(quality_classifier.shape(token), len(model.ids)))
            pooled, n = pooled + model.inner[row], n + 1
        hidden = [np.tanh(a + b) for a, b in zip(pooled / max(n, 1), model.bias)]
        z = (sum(h * o for h, o in zip(hidden, model.outer)) + model.last) / model.temperature
        assert abs(model.score([text])[0] - 1 / (1 + np.exp(-z))) < 1e-5
    y = np.array([i % 2 for i in range(80)])
    assert ((model.score(texts) > 0.5) == y).mean() > 0.95 and model.temperature > 0


def test_letters_of_all_planes():
    model = langid.fit_texts(["the fox and the dog", "the dog and the fox", "le renard et le chien", "le chien et le renard", "𐐨𐐩𐐪𐐫 𐐬𐐭𐐮", "𐐬𐐭𐐮 𐐨𐐩𐐪𐐫"], ["en", "en", "fr", "fr", "deseret", "deseret"])
    none = ["", " ", "🙂", "🙂🙂 123", "\U000E0041\U000E0042", "\ue000\uf8ff", "\U0010FFFF", "12 ½ ٣ €", "\ud800", "ͅ", "𝟘𝟙"]
    assert model.predict([None, *none]) == (["und"] * 12, pytest.approx([0.0] * 12))
    names, score = model.predict(["🙂 the fox 🙂", "𐐀𐐁𐐂𐐃", "漢字", "𠀀"])  # letters beyond the basic plane, in lower case as elsewhere
    assert names[:2] == ["en", "deseret"] and "und" not in names and (score > 0).all()
    grams = langid.Grams()
    assert grams.codes("A🙂b").tolist() == grams.codes(" a b ").tolist() and grams.codes("𐐀").tolist() == [32, ord("𐐨"), 32]


def test_held_out_is_never_null(spark, tmp_path):
    docs = spark.createDataFrame([(None, "some text of a row", "en", "s", 1), (7, "more text", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for q in (queries.op5_toxicity, queries.op6_quality_classifier, queries.op8_language_id):
        assert {r["doc_id"]: r["held_out"] for r in q(spark, str(tmp_path)).collect()}[None] is False


def test_messy_rows(spark, messy, empty):
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 1), (9, 1, 0), (None, 1, 1), (99, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    docs = messy
    for rows, size in ((docs, messy.count()), (empty, 0)):
        t = toxicity.score(rows, toxicity.fit(rows, labels, fold("doc_id", 5) != 99))
        q = quality_classifier.score(rows, quality_classifier.fit(rows, labels, fold("doc_id", 4) != 99))
        lang = langid.predict(rows, langid.fit(rows, fold("doc_id", 4) != 99))
        for out in (t, q, lang):
            assert out.where("score >= 0 AND score <= 1").count() == size
            assert set(out.columns) >= set(messy.columns) and len(out.columns) == len(set(out.columns))
    assert {r["lang_pred"] for r in lang.collect()} == set()
    none = spark.createDataFrame([], labels.schema)
    assert toxicity.score(docs, toxicity.fit(docs, none, F.lit(True))).where("score <= 1").count() == messy.count()
    assert quality_classifier.score(docs, quality_classifier.fit(docs, none, F.lit(True))).where("score = 0.5").count() == messy.count()


def test_noisy_or_weights_are_a_minimum_of_the_plain_objective():
    """The objective by its definition, from texts: no small step in any weight, nor in the bias, makes it less."""
    draw = random.Random(15)
    calm, harsh = ["tree", "river", "stone", "cloud"], ["vile", "scum", "filth"]
    texts, labels = [], []
    for i in range(160):
        sentences = [" ".join(draw.choice(calm) for _ in range(3)) for _ in range(3)]
        if i % 3 == 0:
            sentences[draw.randrange(3)] += " " + draw.choice(harsh)
        texts.append(". ".join(sentences) + ".")
        labels.append(int(i % 3 == 0) if i % 29 else 1)
    model = toxicity.fit_texts(texts, labels, steps=4000)
    assert {w for w in harsh} <= set(model.weights) and not set(calm) & set(model.weights)

    def objective(weights, bias):
        total = 0.0
        for t, y in zip(texts, labels):
            quiet = 1.0
            for s in re.split("[.!?\n]", t):
                if words := set(re.findall(r"\w+", s)):
                    z = bias + sum(weights.get(x, 0.0) for x in {x for w in words for x in toxicity.features(w)})
                    quiet *= 1 - 1 / (1 + np.exp(-z))
            chance = toxicity.NOISE + (1 - toxicity.NOISE) * (1 - quiet)
            total -= np.log(chance) if y else np.log(quiet)  # a label 0 isn't noisy
        return total / len(texts) + toxicity.PENALTY * sum(weights.values())

    least = objective(model.weights, model.bias)
    for name in [*model.weights, *harsh]:
        for step in (-0.1, 0.1):
            changed = model.weights | {name: max(0.0, model.weights.get(name, 0.0) + step)}
            assert objective(changed, model.bias) >= least - 1e-6, (name, step)
    for step in (-0.1, 0.1):
        assert objective(model.weights, model.bias + step) >= least - 1e-6


def test_random_index_vectors_and_training_equal_a_plain_form():
    draw = random.Random(16)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(160)]
    texts = [" ".join(draw.choice(vocabulary[:100] if i % 2 else vocabulary[60:]) for _ in range(60)) + draw.choice([".", " !!", ""]) for i in range(60)]
    labels = [i % 2 for i in range(60)]
    model = quality_classifier.fit_texts(texts, labels)
    split = [re.findall(r"\w+|[^\w\s]+", t) for t in texts]
    seen = {t: sum(t in s for s in map(set, split)) for s in split for t in s}
    split = [[t if seen[t] >= quality_classifier.LEAST else quality_classifier.shape(t) for t in s] for s in split]
    names = sorted({t for s in split for t in s})
    vectors = {}
    for name in names:  # the words around it, each by its own sparse vector
        around = np.zeros(quality_classifier.SIZE)
        for s in split:
            for i, t in enumerate(s):
                if t == name:
                    for j in range(max(0, i - quality_classifier.WINDOW), min(len(s), i + quality_classifier.WINDOW + 1)):
                        if j != i:
                            around += quality_classifier.index_vector(s[j])
        vectors[name] = around / max(np.linalg.norm(around), 1e-9) + quality_classifier.index_vector(name)
    v = np.stack([vectors[n] for n in names])
    assert sorted(model.ids) == names and len(names) > quality_classifier.SIZE
    solved, *_ = np.linalg.lstsq(v, model.inner[[model.ids[n] for n in names]].astype(float), rcond=None)
    assert np.abs(v @ solved - model.inner[[model.ids[n] for n in names]]).max() < 1e-3  # the first layer is linear in them
    x = np.random.default_rng(4).standard_normal((50, 6))
    y = (x[:, 0] > 0).astype(float)
    loss = lambda net: np.logaddexp(0, -quality_classifier._forward(net, x)[0] * (2 * y - 1)).mean() + quality_classifier.DECAY / 2 * sum((net[k] ** 2).sum() for k in (0, 2))
    net = quality_classifier._train(x, y, 6000, np.random.default_rng(5))
    for k, p in enumerate(net):  # by differences the loss is level where the training ended, as it wasn't where it began
        for at in list(np.ndindex(p.shape))[:40]:
            slopes = []
            for trained in (net, quality_classifier._train(x, y, 0, np.random.default_rng(5))):
                ends = []
                for step in (-1e-5, 1e-5):
                    moved = [q.copy() for q in trained]
                    moved[k][at] += step
                    ends.append(loss(moved))
                slopes.append(abs(ends[1] - ends[0]) / 2e-5)
            assert slopes[0] < 2e-3, (k, at, slopes)
