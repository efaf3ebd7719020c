"""Language predictions against a plain version: features, margins and votes spelt out for each document."""

import math
import re

import numpy as np
import pytest

from annulus.llm import langid

TEXTS = {
    "en": "the house and the river were cold when they walked through that old town with their friends",
    "de": "das haus und der fluss waren kalt als sie durch die alte stadt mit ihren freunden gingen",
    "fr": "la maison et la rivière étaient froides quand ils marchaient dans la vieille ville avec leurs amis",
    "es": "la casa y el río estaban fríos cuando caminaban por la vieja ciudad con sus amigos",
    "it": "la casa e il fiume erano freddi quando camminavano per la vecchia città con i loro amici",
}


def grams(text):
    """A document's features as a mapping, gram by gram."""
    letters = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    if not any(c.isalpha() for c in letters):
        return None
    raw, m, top = f" {letters} ".encode(), (1 << 32) - 1, 32 - 13
    counts = {}
    for i, a in enumerate(raw):
        keys = [a * 0x27D4EB2F & m]
        if i + 1 < len(raw):
            two = a * 0x9E3779B1 + raw[i + 1] * 0x85EBCA77 & m
            keys.append((two ^ two >> 15) * 0x2C1B3C6D & m)
            if i + 2 < len(raw):
                three = two * 31 + raw[i + 2] * 0xC2B2AE3D & m
                keys.append((three ^ three >> 15) * 0x297A2D39 & m)
        for k in keys:
            counts[k >> top] = counts.get(k >> top, 0) + 1
    total = sum(counts.values())
    return {k: math.sqrt(c / total) for k, c in counts.items()}


def plain(model, text):
    x = grams(text) if text else None
    if x is None:
        return "und", 0.0
    sure = [1 / (1 + math.exp(-3 * max(-20, min(20, sum(float(w[k]) * v for k, v in x.items()) + float(w[-1]))))) for w in model.weights]
    n = len(model.families) if len(model.families) > 1 else 0
    share = [s / max(1e-9, sum(sure[:n])) for s in sure[:n]] or [1.0]
    family = max(range(len(share)), key=lambda f: (share[f], -f))
    best, places = None, {pair: p for pair, p in zip(model.pairs, sure[n:])}
    for language in model.families[family]:
        votes = [places[language, b] for a, b in places if a == language and b in model.families[family]]
        votes += [1 - places[a, language] for a, b in places if b == language and a in model.families[family]]
        mean = sum(votes) / len(votes) if votes else 1.0
        key = (sum(v > 0.5 for v in votes), mean, -language)
        best = max(best or (key, language, mean), (key, language, mean))
    return model.names[best[1]], share[family] * best[2]


def test_predictions_are_those_of_a_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(260):
        lang = sorted(TEXTS)[i % 5]
        words = TEXTS[lang].split()
        rows.append((i, " ".join(rng.choice(words, rng.integers(3, 40))), lang))
    rows += [(900, None, "en"), (901, "12 34 ...", "en"), (902, "", None), (None, TEXTS["en"], "en"), (903, TEXTS["fr"] * 4000, None), (904, "日本語 text", None), (904, TEXTS["es"], "es"), (904, TEXTS["es"], "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs, per_lang=25)
    assert len(model.names) == 5 and len(model.families) == 2
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in langid.predict(docs, model).collect())
    want = sorted((str(i), *plain(model, text)) for i, text, _ in rows)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert [s for _, _, s in got] == pytest.approx([s for _, _, s in want], abs=1e-4)


def test_features_are_those_of_a_plain_version():
    for text in [*TEXTS.values(), "a", "É", " x1y2 ", "日本語 text", "A-b_C"]:
        v, x = langid.features(text), grams(text)
        assert set(np.flatnonzero(v)) == set(x) and all(abs(v[k] - s) < 1e-5 for k, s in x.items())
