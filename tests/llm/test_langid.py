"""Problem 6: trained on generated sentences, measured on held-out ones."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlake.llm import langid as L

WORDS = {
    "en": "the house was very old and we walked through every room with our friends before dinner because nobody knew which street they wanted".split(),
    "es": "la casa era muy vieja y caminamos por todas las calles con nuestros amigos antes de cenar porque nadie sabía qué querían hacer".split(),
    "de": "das haus war sehr alt und wir gingen durch jedes zimmer mit unseren freunden vor dem essen weil niemand wusste welche straße".split(),
    "ru": "дом был очень старый и мы прошли через каждую комнату с нашими друзьями перед ужином потому что никто не знал".split(),
}


def sentence(rng, lang):
    return " ".join(rng.choices(WORDS[lang], k=9)).capitalize() + "."


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    texts, labels, truth = [], [], {}
    for i in range(700):
        lang = rng.choice(list(WORDS))
        langs = [lang] * rng.randint(1, 3)
        if i % 10 == 0:
            langs.append(rng.choice([x for x in WORDS if x != lang]))
        truth[f"p{i}"] = set(langs)
        texts.append((f"p{i}", " ".join(sentence(rng, x) for x in langs), "clash"))
        said = rng.choice(["en", "es"]) if i % 13 == 5 else lang
        labels.append((f"p{i}", {"en": "English", "es": "es-MX", "de": "deu", "ru": "русский"}[said] if i % 7 else rng.choice([None, " ", "und"])))
    texts += [("empty", None, ""), ("blank", "  ", ""), ("tags", "#one #two 🙂 @me", "")]
    return spark.createDataFrame(texts, "id string, text string, lang string"), spark.createDataFrame(labels + labels[:20], "id string, label string"), truth


@pytest.mark.parametrize("label, want", [(" en_GB ", "en"), ("Español", "es"), ("pt-BR", "pt"), ("JPN", "ja"), ("xx", None), ("n/a", None), ("", None), (None, None), ("?", None), ("unknown", None), ("nl", "nl"), ("Deutsch", "de"), ("zh-Hant-TW", "zh")])
def test_label_code(spark, label, want):
    assert spark.createDataFrame([(label,)], "x string").select(L.label_code(F.col("x"))).first()[0] == want


def test_sentences():
    text = "Ich ging nach Hause. @me #tag 🙂 ISO 6400, f/1.8 Mara Quill. We all walked home now! 店が開く前に来ました。"
    assert [text[a:b].strip() for a, b, _ in L.sentences(text)] == ["Ich ging nach Hause.", "We all walked home now!", "店が開く前に来ました。"]
    assert L.sentences("") == []


def test_held_out_accuracy(data):
    captions, labels, truth = data
    model = L.fit(captions, labels)
    assert (model.weights == 0).mean() > 0.5  # sparse
    rng = random.Random(99)
    test = [(x, f" {sentence(rng, x).lower()} ") for x in WORDS for _ in range(100)]
    p = model.probabilities([t for _, t in test])
    assert np.mean([model.languages[k] == x for k, (x, _) in zip(p.argmax(axis=1), test, strict=True)]) > 0.97
    assert np.allclose(p.sum(axis=1), 1)
    found = {(r.id, r.lang) for r in L.mislabelled(L.text_languages(L.segments(captions, model)), labels).collect()}
    declared = {}
    for r in labels.select("id", L.label_code(F.col("label")).alias("c")).where("c IS NOT NULL").collect():
        declared[r.id] = r.c
    want = {(i, x) for i, langs in truth.items() if len(langs) > 1 or declared.get(i) not in langs for x in langs}
    assert len(found & want) / len(want) > 0.95 and len(found - want) / len(want) < 0.05
    assert not {i for i, _ in found} & {"empty", "blank", "tags"}
    every = {r.id: (r.lang, r.confidence) for r in L.text_languages(L.segments(captions, model)).collect()}
    assert every.keys() == {*truth, "blank", "tags"}  # a null text is none
    assert all(every[i] == (None, 0.0) for i in ("blank", "tags")) and all(0 < c <= 1 for x, c in every.values() if x)


def test_segments_are_places_in_the_text_as_it_was_written(spark, data):
    captions, labels, _ = data
    model = L.fit(captions, labels)
    text = "T\u200bhе hоuse w\u00adas v\u0435ry old. \uff34he house was very old. ｄas haus war sehr alt!\r\nМама шла домой через каждую комнату. cafe\u0301 la casa era muy vieja"
    df = spark.createDataFrame([("x", text), ("n", None)], "id string, text string")
    got = [(text[r.start : r.end].strip(), r.lang) for r in L.segments(df, model).orderBy("segment").collect()]
    assert [g for g, _ in got] == ["T\u200bhе hоuse w\u00adas v\u0435ry old.", "\uff34he house was very old.", "ｄas haus war sehr alt!", "Мама шла домой через каждую комнату.", "cafe\u0301 la casa era muy vieja"]
    assert [x for _, x in got] == ["en", "en", "de", "ru", "es"]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs", "Cc", "Cf", "Zl", "Zp")), max_size=40))
def test_aligned_form_is_the_normal_form(text):
    form, at = L.aligned(text)
    assert len(at) == len(form) + 1 and at == sorted(at) and at[-1] == len(text)
    if not text.isupper():
        assert unicodedata.normalize("NFC", form).split() == L.normal(text).split()


def test_unfit_input(spark, data):
    captions, labels, _ = data
    with pytest.raises(ValueError):
        L.fit(captions, labels.where("label = 'English'"))
    with pytest.raises(ValueError):
        L.fit(captions.limit(0), labels)
