"""Every labelled language is learnt; features and predictions against plain versions."""

import math
import random

import numpy as np
import pytest

from sparkquarry.llm import langid


def test_no_language_is_left_out(spark):
    rng = random.Random(9)
    docs = []
    for k in range(200):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)]
        docs += [(4 * k + j, " ".join(rng.choice(words) for _ in range(40)), f"l{k:03}") for j in range(4)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = {r.id: r.lang_pred for r in langid.predict(table, langid.train(table)).collect()}
    assert set(found.values()) == {lang for *_, lang in docs}
    assert sum(found[i] == lang for i, _, lang in docs) >= 0.9 * len(docs)


def plain_features(text):
    folded = []
    for c in text.lower() if text.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in text):
        c = c if c >= 128 or 97 <= c <= 122 else 32
        if c != 32 or not folded or folded[-1] != 32:
            folded.append(c)
    counts = [0] * langid.BUCKETS
    for n, salt in ((1, 0x9E3779B1), (2, 0x85EBCA77), (3, 0xC2B2AE3D)):
        for i in range(len(folded) - n + 1):
            gram = 0
            for c in folded[i : i + n]:
                gram = (gram * 257 + c) % (1 << 32)
            counts[(gram * salt) % (1 << 32) >> 20] += 1
    norm = math.sqrt(sum(counts))
    return [math.sqrt(x) / norm for x in counts] if norm else [0.0] * langid.BUCKETS


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 1 << 20])
def test_features_are_those_of_one_pass(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    for text in (b"", b"a", b"  ", "Été, à l'ombre -- 12 x  y\n\nzZ".encode(), b"ab  cd" * 9, "漢字 и слово".encode() * 3):
        assert langid.features(text) == pytest.approx(plain_features(text), abs=1e-6)


def test_long_texts_have_the_features_of_their_parts():
    part = "Der schnelle braune Fuchs springt, und noch einmal. ".encode()
    text = part * (3 * (1 << 20) // len(part) + 1)
    assert len(text) > 3 * (1 << 20)
    whole = np.bincount(np.arange(3))  # the same text in one block
    langid.BLOCK, usual = len(text) + 1, langid.BLOCK
    try:
        whole = langid.features(text)
    finally:
        langid.BLOCK = usual
    assert np.array_equal(langid.features(text), whole)


def plain_prediction(model, x):
    """Margins and votes, written out."""
    margin = lambda w: sum(a * b for a, b in zip(w, [*x, 1.0]))
    squash = lambda m: 1 / (1 + math.exp(-m))
    family, sure = next(iter(model.members)), 1.0
    if model.families:
        margins = sorted(((margin(w.tolist()), f) for f, w in model.families.items()), key=lambda m: (-m[0], m[1]))
        family, sure = margins[0][1], squash(margins[0][0] - margins[1][0])
    votes = {lang: 0.0 for lang in model.members[family]}
    for (a, b), w in model.pairs.items():
        if a in votes:
            p = squash(2 * margin(w.tolist()))
            votes[a], votes[b] = votes[a] + p, votes[b] + 1 - p
    lang = min(votes, key=lambda k: (-votes[k], k))
    return lang, sure * (min(1.0, votes[lang] / (len(votes) - 1)) if len(votes) > 1 else 1.0)


def test_predictions_equal_a_plain_version():
    rng = np.random.default_rng(5)
    langs = ["en", "de", "fr", "es", "it", "xx", "ru"]
    centres = rng.random((len(langs), langid.BUCKETS))
    rows = [(lang, c + rng.random(langid.BUCKETS)) for lang, c in zip(langs, centres) for _ in range(6)]
    unit = lambda v: (v / np.sqrt((v * v).sum())).astype(np.float32)
    model = langid.Discriminator(np.stack([unit(v) for _, v in rows]), [lang for lang, _ in rows])
    assert set(model.members) == {"germanic", "romance", "slavic", "xx"} and len(model.pairs) == 4
    for lang, v in rows:
        said, score = model.predict(unit(v))
        plain, sure = plain_prediction(model, unit(v).tolist())
        assert said == plain == lang and score == pytest.approx(sure, abs=1e-3)


def test_one_language_or_ties(spark):
    """With one language all texts are its; equal votes go to the first by name."""
    docs = spark.createDataFrame([(1, "some words", "xx"), (2, "other words here", "xx"), (3, None, "xx"), (4, "12 34", None)], "doc_id long, text string, lang string")
    found = {r.id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.train(docs)).collect()}
    assert found[1] == found[2] == ("xx", 1.0) and found[3] == found[4] == ("und", 0.0)
    model = langid.Discriminator(np.ones((4, langid.BUCKETS), np.float32), ["en", "de", "de", "en"])
    assert model.predict(np.zeros(langid.BUCKETS, np.float32))[0] == "de"
