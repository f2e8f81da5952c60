"""Scores against plain arithmetic, and what the distance rejects and keeps."""

import math
import random
import string

import numpy as np
import pytest

from lifecurve.llm import langid


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def plain_vector(text, idf):
    """The n-grams one by one, in Python integers."""
    said = "".join(chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in f" {text.lower()} ".encode())
    while "  " in said:
        said = said.replace("  ", " ")
    raw, counts = said.encode("latin-1"), {}
    for n, seed in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        for k in range(len(raw) - n + 1):
            place = (int.from_bytes(raw[k : k + n], "big") * seed % 2**32 >> 16) % len(idf)
            counts[place] = counts.get(place, 0) + 1
    out = {k: math.log1p(c) * float(idf[k]) for k, c in counts.items()}
    length = math.sqrt(sum(v * v for v in out.values()))
    return {k: v / length for k, v in out.items()}


def test_scores_equal_plain_arithmetic(model):
    texts = ["The weather was fine and we walked along the river.", "Ça va très bien, l'été est là!", "x", "größer als 12 Häuser", "a-b_c 3.14 " * 50]
    langs, scores, _ = model.predict(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        vector = plain_vector(text, model.idf)
        cosines = [sum(v * float(c[k]) for k, v in vector.items()) for c in model.centroids]
        best = int(np.argmax(cosines))
        assert lang == model.langs[best] and score == pytest.approx(min(max(cosines[best], 0), 1), abs=1e-5)


GOOD = {
    "en": ["It was late and the rain had not stopped since the morning.", "He said that they would come home before the winter and bring all of the letters with them."],
    "de": ["Es war spät und der Regen hatte seit dem Morgen nicht aufgehört.", "Sie sagte, dass wir mit den Kindern nach Hause gehen und die Briefe lesen sollten."],
    "fr": ["Il était tard et la pluie n'avait pas cessé depuis le matin.", "Elle a dit que nous devions rentrer à la maison avec les enfants pour lire les lettres."],
    "es": ["Era tarde y la lluvia no había parado desde la mañana.", "Ella dijo que teníamos que volver a casa con los niños para leer todas las cartas."],
}
UNSEEN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
]


def test_clean_texts_stay(model):
    for lang, texts in GOOD.items():
        for text in texts:
            langs, scores, rejected = model.predict([text, " ".join(texts)])
            assert langs == [lang, lang] and not rejected.any(), (text, scores)


@pytest.mark.parametrize("words", [30, 100, 300, 2000])
def test_noise_goes(model, words):
    rnd = random.Random(words)
    letters = [" ".join("".join(rnd.choice(string.ascii_lowercase) for _ in range(rnd.randrange(2, 9))) for _ in range(words)) for _ in range(40)]
    hexed = [" ".join(f"{rnd.getrandbits(32):08x}" for _ in range(words)) for _ in range(40)]
    based = ["".join(rnd.choice(string.ascii_letters + string.digits + "+/") for _ in range(words * 5)) for _ in range(40)]
    for kind in (letters, hexed, based):
        assert model.predict(kind)[2].mean() >= 0.95
    assert model.predict([t * max(1, words // 30) for t in UNSEEN])[2].all()


def test_rejection_hardly_touches_the_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, model).where("lang_pred <> 'und'")
    assert found.where("rejected").count() <= 0.01 * found.count()
