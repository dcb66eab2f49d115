import random

import sentencepiece

from textloom.llm import license_scan, queries
from textloom.llm import sentencepiece_codec as S

from ..oracle import same


def test_ids_equal_the_library_and_round_trip():
    v = S.Vocabulary.load()
    encoder, decoder, model = S.Encoder(v), S.Decoder(v), sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    draw = random.Random(6)
    signs = "abcdefghij  \nétionslerè.,!0123ABCD日本語кот<>/=_-\"²½▁\t\x00🙂"
    texts = ["", " ", "\n", "  a  b\n\nc ", "a▁b", "m² and m2", "<s> <0x0A>", "a" * 700, " " * 90 + "x", "漢字" * 200]
    texts += ["".join(draw.choice(signs) for _ in range(draw.randint(1, 150))) for _ in range(600)]
    ids, n = encoder.encode(texts)
    at = 0
    for text, size, back in zip(texts, n.tolist(), decoder.decode(ids, n)):
        assert ids[at : at + size].tolist() == model.encode(text)
        assert back.decode() == text.replace("▁", " ")
        at += size


def test_edges_are_all_occurrences_of_all_pieces(monkeypatch):
    import numpy as np

    encoder = S.encoder_of(S.Vocabulary.load())
    draw = random.Random(4)
    text = S.SPACE + "".join(draw.choice(["the", "ing", "ation", S.SPACE, "s", "1", "é", ", ", "internationalization"]) for _ in range(300))
    start, piece = encoder._edges(encoder._symbol(S._codes(text)))
    want = {(i, encoder.vocabulary.ids[text[i:j]]) for i in range(len(text)) for j in range(i + 1, min(len(text), i + 16) + 1) if text[i:j] in encoder.vocabulary.ids}
    assert set(zip(start.tolist(), piece.tolist())) == want and len(start) == len(want)
    texts = ["".join(draw.choice("ab c.d\n1é漢") for _ in range(draw.randint(0, 300))) for _ in range(40)]
    whole = encoder.encode(texts)
    monkeypatch.setattr(S, "BLOCK", 64)  # the same ids from small blocks, and with a full table of pairs
    monkeypatch.setattr(S, "PAIRS", 50)
    small = S.Encoder(encoder.vocabulary).encode(texts)
    assert all(np.array_equal(a, b) for a, b in zip(whole, small))


def test_frames(spark, messy, empty):
    out = S.encode(messy)
    got = out.collect()
    assert len(got) == messy.count() and all(r["round_trip"] for r in got if r["ids"] is not None)
    assert sorted(str(r["text"]) for r in S.decode(out).collect()) == sorted(str(r["text"]) for r in messy.collect())
    assert all(r["ids"] is None and not r["round_trip"] for r in got if r["doc_id"] == 1)
    assert S.encode(empty).count() == 0


def test_licenses_equal_their_sql(spark):
    sf = "/root/testdata/sf0.01"
    same(queries.op9_license_scan(spark, sf), license_scan.oracle(), sf)


def plain(text, template, least=0.8):
    import re

    words = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    s, t = grams(words(text)), set(grams(words(template)))
    span = -(-5 * len(t) // 4)
    return max((len(set(s[i : i + span]) & t) for i in range(len(s))), default=0) >= least * len(t)


def test_edited_and_repeated_templates(spark, messy, empty):
    draw = random.Random(8)
    templates, rows = license_scan.TEMPLATES, []
    for i, (_, text) in enumerate(list(templates.items()) * 6):
        words = text.split()
        for _ in range(draw.randint(0, 5)):
            words[draw.randrange(len(words))] = draw.choice(["foo", "bar"])
        filler = [f"f{draw.randrange(99)}" for _ in range(draw.randint(0, 60))]
        rows.append((i, " ".join(filler + words * draw.randint(1, 3) + filler)))
    rows += [(1000, None), (1001, ""), (1002, "the license"), (1003, templates["mit-text"] * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan(docs).collect()}
    assert got == {(i, name) for i, text in rows for name, t in templates.items() if plain(text, t)}
    assert license_scan.scan(messy).count() == 0 and license_scan.scan(empty).count() == 0


def test_no_python_on_the_main_path(spark, sf):
    plan = queries.op9_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
