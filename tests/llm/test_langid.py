import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from quirelight.llm.langid import MOST_GRAM, Scorer, fit, grams_of, held_out, identify, predict

EN = "the house and the garden of a king were old and the water was cold"
FR = "la maison et le jardin du roi étaient vieux et l'eau était froide"


def rows():
    r = np.random.default_rng(0)
    out = []
    for i in range(80):
        base = (EN if i % 2 else FR).split()
        out.append((i, " ".join(r.choice(base, 12)), "en" if i % 2 else "fr", 1.0))
    return out + [(100, None, "en", 0.0), (101, "", "fr", 0.0), (102, "12 _ 34 !", "en", 0.0), (103, "ж", None, 0.0), (104, "The KING " * 20000, None, 0.0), (104, "gardenish", None, 0.0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, score double")


def test_identify(spark, docs):
    got = identify(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows())
    by = {(r["doc_id"], r["lang_pred"]): r for r in got}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all((i, "und") in by for i in (100, 101, 102)) and (104, "en") in by
    assert np.mean([(i, lang) in by for i, _, lang, _ in rows()[:80]]) > 0.95


def plain(train):
    """A scorer that sums over words as the docstring says, in dictionaries."""
    words, grams, docs = defaultdict(Counter), defaultdict(Counter), Counter()
    for t, lang in train:
        docs[lang] += 1
        for w in regex.findall(r"\p{L}+", t.lower()):
            words[lang][w] += 1
            for n in range(1, MOST_GRAM + 1):
                grams[lang, n].update(grams_of(w, n))
    langs = sorted(docs)
    size = lambda of: len({k for x in langs for k in of(x)})

    def value(of, key):
        keys = size(of)
        return np.array([np.log((of(x)[key] + 0.1) / (sum(of(x).values()) + 0.1 * keys + 0.1)) for x in langs])

    def word(w):
        if any(w in words[x] for x in langs):
            return value(words.__getitem__, w)
        for n in range(MOST_GRAM, 0, -1):
            if found := [g for g in grams_of(w, n) if any(g in grams[x, n] for x in langs)]:
                return np.mean([value(lambda x: grams[x, n], g) for g in found], 0)  # noqa: B023
        return np.zeros(len(langs))

    def score(text):
        found = regex.findall(r"\p{L}+", (text or "").lower())
        if not found:
            return "und", 0.0
        total = np.log([docs[x] / sum(docs.values()) for x in langs]) + sum(map(word, found))
        p = np.exp((total - total.max()) / len(found))
        return langs[total.argmax()], p.max() / p.sum()

    return score


def test_equals_plain_sums(spark, docs):
    train = [(t, lang) for i, t, lang, _ in rows() if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 5]
    want, got = plain(train), Scorer(fit(docs.where(~held_out())))
    texts = [t for _, t, _, _ in rows()] + ["gardens", "maisonnette the", "ξ", "x² ½ the", "½ ²", "②", "Ⅷ", "naïve", "ΣΑΣ", "the½king"]
    for t, (lang, score) in zip(texts, got(texts)):
        w = want(t)
        assert lang == w[0] and abs(score - w[1]) < 1e-5, t
    assert [x for x, _ in got(["½ ²", "②", "٣"])] == ["und"] * 3


def test_every_word_of_the_sample_is_learned(spark):
    once = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)}", "en") for i in range(600)]
    model = fit(spark.createDataFrame(once, "doc_id long, text string, lang string"))
    assert len(model.words.keys) == 600
    bounded = fit(spark.createDataFrame(once, "doc_id long, text string, lang string"), max_docs_per_lang=100)
    assert 50 < len(bounded.words.keys) < 160


def test_nothing_learned(spark, docs):
    empty = docs.where("false")
    assert identify(empty).collect() == []
    got = predict(docs, fit(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["lang_pred"] for r in got.collect()} == {"und"}
