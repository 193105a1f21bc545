"""Marginals of words against the sum over all labelings."""

from itertools import product

import numpy as np
import pytest

from corvane.llm import crf


def enumerated(tagger, text):
    """Each word's marginals: every labeling weighed by its emissions and moves."""
    words = [w for w in map(crf.letters, text.lower().split()) if w]
    e = np.exp(crf.emissions(words, tagger.lexicon, tagger.weights).astype(float))
    k, n = len(tagger.labels), len(words)
    out = np.zeros((n, k))
    for y in product(range(k), repeat=n):
        w = np.prod([e[i, y[i]] for i in range(n)]) * np.prod([tagger.move[y[i], y[i + 1]] for i in range(n - 1)])
        for i in range(n):
            out[i, y[i]] += w
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("segment", [1, 2, 3, 64])
def test_marginals_equal_enumeration(monkeypatch, segment):
    """Within one segment and over the boundaries of several; first words and texts of one word too."""
    monkeypatch.setattr(crf, "SEGMENT", segment)
    rng = np.random.default_rng(9)
    model = (["de", "en", "fr"], {"haus": 0}, rng.normal(size=(crf.HASHED + 1, 3)).astype(np.float32) * 2, rng.normal(size=(3, 3)).astype(np.float32) * 2)
    tagger = crf.Tagger(model)
    texts = ["Das Haus, the house - la maison et der Hund", "word", "12 34", None, "deux mots", "a b c d e f g"]
    sums, n, words = tagger.marginals(texts, keep=True)
    for i, text in enumerate(texts):
        if n[i]:
            want = enumerated(tagger, text)
            assert np.abs(words[i] - want).max() < 1e-6 and np.abs(sums[i] - want.sum(axis=0)).max() < 1e-6
    assert n.tolist() == [9, 1, 0, 0, 2, 7]


def test_long_texts_train_by_a_span(spark):
    long = " ".join(f"wort{i}" for i in range(9000))
    df = spark.createDataFrame([(i, long if i == 1 else f"text {i}", "de") for i in (1, 3, 4)], "doc_id bigint, text string, lang string").filter(~crf.held_out(crf.F.col("doc_id")))
    rows = crf.training_rows(df)
    spans = [t for t, _ in rows if len(t) > 100]
    assert len(rows) == df.count() and all(crf.TRAIN_CHARS - 30 < len(t) <= crf.TRAIN_CHARS and set(t.split()) <= set(long.split()) for t in spans)
