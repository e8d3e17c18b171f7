import random
import zlib

import numpy as np
import pytest

from reviewloom.llm import langid

DOCS = "text STRING, lang STRING, score STRING"
WORDS = {"en": "the and of with this that from thing house water", "de": "der und nicht mit über für straße haus wasser",
         "fr": "le et dans avec été où ça maison eau", "el": "και το νερό σπίτι με από αυτό"}


def texts(seed, n):
    rng = random.Random(seed)
    return [(" ".join(rng.choices(WORDS[lang].split(), k=rng.randrange(3, 30))), lang, "x") for lang in WORDS for _ in range(n)]


def test_spectrum_is_the_set_of_ngrams():
    frequent = [ord(c) for c in "abcé"]
    spectrum = langid.Spectrum(frequent)

    def brute(text):
        symbols = [2 + "abcé".index(c) if c in "abcé" else int(c.isalpha()) for c in text.lower()]
        padded = [0]
        for s in [*symbols, 0]:
            if s or padded[-1]:
                padded.append(s)
        if not any(padded):
            return set()
        out, offset = set(), 0
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                value = 0
                for s in padded[i : i + n]:
                    value = value * 128 + s
                out.add(value + offset)
            offset += 128**n
        return out

    for text in ["", "...", "a", "abc cab", " É ééz1b\n\nb-a", "中a \U0001f600", "aaaaaa" * 50]:
        grams = spectrum(text).tolist()
        assert len(grams) == len(set(grams)) and set(grams) == brute(text)
    assert spectrum(None).tolist() == []


def test_folded_weights_are_kernel_ridge_regression():
    rng = np.random.default_rng(0)
    labels = np.repeat([0, 1, 2], 8)
    spectra = [np.unique(rng.integers(0, 60, 25) + 40 * k).astype(np.int32) for k in labels]
    addresses, weights = langid.ridge_weights(spectra, labels, 3, len(spectra), 1e-2)
    model = langid.Model(["a", "b", "c"], [], addresses, weights)
    kernel = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in spectra] for a in spectra])
    target = np.where(labels[:, None] == np.arange(3), 1.0, -1.0)
    # With all rows as landmarks this is (K + n ridge I)^-1 Y; every row weighs 1/n.
    exact = kernel @ np.linalg.solve(kernel + len(labels) * 1e-2 * np.eye(len(labels)), target)
    assert np.allclose(model.scores(spectra), exact, atol=1e-3)


def test_accuracy_and_odd_texts(spark):
    model = langid.fit(spark.createDataFrame(texts(1, 60), DOCS), rows=120, landmarks=40)
    assert model.languages == sorted(WORDS)
    odd = [(None, "en", None), ("", None, None), ("12 34 !!", "de", None), ("the " * 60_000, "fr", None)]
    found = langid.predict(spark.createDataFrame(texts(2, 30) + odd, DOCS).repartition(3), model).collect()
    assert all(0 <= r.score <= 1 for r in found)
    right = [r.lang_pred == r.lang for r in found if r.has_letters and len(r.text) < 10_000]
    assert len(right) == 120 and np.mean(right) > 0.97
    assert [r.lang_pred for r in found if not r.has_letters] == ["und"] * 3
    assert [r.lang_pred for r in found if r.text and len(r.text) > 10_000] == ["en"]


def test_lang_is_no_input(spark):
    model = langid.fit(spark.createDataFrame(texts(1, 20), DOCS), rows=60, landmarks=20)
    rows = texts(3, 5)
    one = langid.predict(spark.createDataFrame(rows, DOCS), model).collect()
    other = langid.predict(spark.createDataFrame([(t, "zz", s) for t, _, s in rows], DOCS), model).collect()
    assert [(r.lang_pred) for r in one] == [r.lang_pred for r in other]


@pytest.mark.parametrize("rows", [[], [(None, "en", None), ("a b", None, None)], [("...", "en", None)]])
def test_nothing_to_learn_from(spark, rows):
    model = langid.fit(spark.createDataFrame(rows, DOCS))
    assert model is None
    found = langid.predict(spark.createDataFrame([("text", "en", None), (None, None, None)], DOCS), model)
    assert [(r.lang_pred, r.score, r.has_letters) for r in found.collect()] == [("und", 0.0, True), ("und", 0.0, False)]


def test_query(spark):
    from reviewloom.llm.queries import op5_string_kernel_language

    sf = "/root/testdata/sf0.001"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op5_string_kernel_language(spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in found if r.held_out]) > 0.9
