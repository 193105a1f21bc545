"""Word numbers of many texts at once and sums of blocks, against the plain ways."""

import random

import numpy as np
import pyarrow as pa

from corvane.llm.decontaminate import Finder, Ids


def test_texts_together_have_the_numbers_that_each_has_alone():
    rng = random.Random(1)
    chars = [*map(chr, range(256)), *"ab " * 60]
    low = ["".join(rng.choices(chars, k=200)) for _ in range(100)]
    high = ["".join(rng.choices([*chars, *"\u6f22\u0130\u03a3\u2028"], k=200)) for _ in range(30)]
    ids = Ids({"a": 0, "b": 1, "ab": 2, "\u00e9": 3, "\u6f22": 4, "\u00df": 5})
    for texts in (pa.array([None, "", " .. ", *low, *high]), pa.array(["x", *low]).slice(1), pa.array([None], pa.string()), pa.array([], pa.string())):
        got = ids.of_all(texts)
        assert len(got) == len(texts)
        assert all(np.array_equal(ids.of(t.as_py()), x) for t, x in zip(texts, got))


def test_a_block_is_the_sum_of_its_words():
    rng = np.random.default_rng(2)
    found = [(1, [0, 1, 2, 3, 4, 5]), (2, [5, 6, 7, 8, 9, 10, 11])]
    finder = Finder(found, {f"w{i}": i for i in range(12)}, np.ones(12, dtype=np.float32), rng.standard_normal((12, 4)).astype(np.float32))
    sizes = np.array([3, 0, 32, 1, 0, 7])
    begin, word = np.concatenate([[0], np.cumsum(sizes)]), rng.integers(0, 12, sizes.sum())
    some = np.array([0, 1, 2, 4, 5])
    want = np.array([finder.space[word[begin[b] : begin[b + 1]]].sum(axis=0) for b in some])
    assert np.allclose(finder.block_sums(word, begin, some), want, atol=1e-5)
    assert finder.block_sums(word, begin, some[:0]).shape == (0, 4)
