"""Texts with and without runs of white space take different patterns, and get the library's ids from both."""

import random

import numpy as np
import pytest

from corvane.llm import vocab


@pytest.fixture(scope="module")
def coder():
    with open(vocab.default_path("byte_bpe_50k.json"), "rb") as f:
        return vocab.encoder((f.read(), True))


def test_only_texts_with_runs_need_the_pattern_that_looks_ahead(coder, monkeypatch):
    monkeypatch.setattr(coder, "slow", None)
    for text in ("The cat\nsat on it's mat. ", " a\tb\u00a0c\r", "", "\n", "caf\u00e9 12 '!' don't"):
        assert np.array_equal(coder(text), coder.library(text))
    assert coder.slow is None
    assert np.array_equal(coder("a  b"), coder.library("a  b")) and coder.slow is not None


def test_both_patterns_equal_the_library(coder):
    rng = random.Random(3)
    for blanks in (" ", " \n", " \n\t\r\x0b\x0c\x85\xa0"):
        for _ in range(300):
            some = [rng.choice(["a", "'s", "word", "12", "!", "\u00e9", "_", *blanks, *blanks, *blanks]) for _ in range(rng.randrange(30))]
            text = "".join(some)
            assert np.array_equal(coder(text), coder.library(text)), repr(text)
            single = vocab.RUN.sub(lambda m: m[0][0] + "x", text)
            assert np.array_equal(coder(single), coder.library(single)), repr(single)
