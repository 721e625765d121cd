"""What the language step holds at once: neither long texts, nor many of them, nor many languages make it more."""

import tracemalloc

import numpy as np
import pytest

from signaloom.llm import language_id

#: Long texts, many texts, marks only, nothing.
TEXTS = ["ein Satz mit Wörtern. " * 40_000, None, "", "!? 12", *(f"text {k} of many, " * 100 for k in range(400)), "é" * 300_000]
MB = 1 << 20


def model(languages):
    language_id._folding()  # a table of its own, made once
    weights = np.random.default_rng(1).normal(-9, 2, (1 << language_id.BUCKET_BITS, languages)).astype(np.float32)
    fits = np.full(languages, -9.0)
    return language_id.LanguageModel([f"l{k:03}" for k in range(languages)], weights, np.zeros(languages), least_fit=fits)


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("languages", (4, 40))
def test_scoring_holds_few_ngrams(languages):
    own = model(languages)
    assert peak_mb(lambda: own.predict(TEXTS)) < 90


def test_fit_of_a_long_text_holds_few_ngrams():
    own, text = model(1), "ein Satz mit Wörtern. " * 200_000
    assert peak_mb(lambda: own.fit_by_others(text, 0, 1e8, 0.1)) < 90


def test_counting_holds_few_ngrams():
    assert peak_mb(lambda: language_id.ngram_counts(TEXTS * 3)) < 90


def test_slices_give_the_same_sums(monkeypatch):
    own = model(5)
    texts = TEXTS[1:30] + ["ein Satz mit Wörtern. " * 300, "y", "x y" * 100]
    pieces = [list(language_id.ngram_buckets(t or "")) for t in texts]
    ids = [np.concatenate(p) if p else np.zeros(0, np.int32) for p in pieces]
    naive = np.array([own.weights[i].astype(float).sum(axis=0) for i in ids])
    counts = np.bincount(np.concatenate(ids), minlength=1 << language_id.BUCKET_BITS)
    fit = own.fit_by_others(texts[-3], 2, 1e6, 0.1)
    for at_once, cells in ((1 << 18, 1 << 20), (1, 1), (700, 1500)):
        monkeypatch.setattr(language_id, "AT_ONCE", at_once)
        monkeypatch.setattr(language_id, "CELLS", cells)
        sums, n = own.sums(texts)
        assert n.tolist() == [len(i) for i in ids]
        assert np.allclose(sums, naive, rtol=1e-12, atol=1e-9)
        assert (language_id.ngram_counts(texts) == counts).all()
        assert own.fit_by_others(texts[-3], 2, 1e6, 0.1) == fit
    assert np.isnan(own.fit_by_others("!", 2, 1e6, 0.1))
