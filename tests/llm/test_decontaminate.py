"""Decontamination against brute force, on rewordings, short items and large benchmarks."""

import numpy as np
import pytest

from corvane.llm import decontaminate


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute(data, items):
    """(doc, item) of every window of three blocks that holds enough of an item's words, in order, and of its last quarter."""
    out = set()
    for d, text in data:
        words = decontaminate.words_of(text)
        for i, t in items:
            w = decontaminate.words_of(t)
            for at in range(-64, len(words), 32):
                window = words[max(at, 0) : at + 96]
                if lcs(w, window) >= 0.6 * len(w) and lcs(w[-max(1, len(w) // 4) :], window) >= 0.5 * max(1, len(w) // 4):
                    out.add((d, i))
                    break
    return out


def language(seed):
    """A text maker whose words are as uneven as those of a language."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(3000)]
    p = 1 / np.arange(3, 3003)
    return rng, lambda n: rng.choice(words, n, p=p / p.sum()).tolist()


def reworded(rng, w, share, swap):
    """Other words in place of a share of w, and neighbours that change places."""
    w = [f"other{rng.integers(0, 500)}" if rng.random() < share else x for x in w]
    for k in range(0, len(w) - 1, 2):
        if rng.random() < swap:
            w[k], w[k + 1] = w[k + 1], w[k]
    return w


def test_against_brute_force_and_on_rewordings(spark, docs):
    rng, text = language(3)
    items = [(i, " ".join(text(int(rng.integers(15, 60))))) for i in range(40)]
    data = [(i, " ".join(text(int(rng.integers(5, 400))))) for i in range(150)]
    for i, t in items:
        for k, (share, swap) in enumerate([(0, 0), (0.1, 0.1), (0.2, 0.1), (0.15, 0.25), (0.3, 0), (0.45, 0), (0.7, 0)]):
            data.append((1000 + 10 * i + k, " ".join([*text(int(rng.integers(0, 150))), *reworded(rng, t.split(), share, swap), *text(int(rng.integers(0, 60)))])))
    want = brute(data, items)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(data), bench).collect()}
    assert got <= want and len(got) / len(want) > 0.95
    gentle = {(1000 + 10 * i + k, i) for i, _ in items for k in range(4)}  # copies, and at most a fifth reworded
    assert len(got & gentle) / len(gentle & want) > 0.97 and len(gentle & want) / len(gentle) > 0.9


def test_short_items_and_scripts_without_spaces(spark, docs):
    items = [(1, "quite so"), (2, "42"), (3, "the answer is four"), (4, "日本語の文章はここにあります"), (5, "猫")]
    data = [(1, "It is quite, so to say"), (2, "Quite SO!"), (3, "so quite"), (4, "number 42."), (5, "The answer is: four"), (6, "the answer four is"), (7, "前に日本語の文章はここにあります後"), (8, "犬と猫がいる"), (9, None), (10, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(data), bench).collect()}
    assert got == {(1, 1), (2, 1), (4, 2), (5, 3), (7, 4), (8, 5)}
    assert {r.doc_id for r in decontaminate.keep_clean(docs(data), bench).collect()} == {3, 6, 9, 10}


@pytest.mark.parametrize("group, words", [(1, 1 << 14), (4, 300)])
def test_large_benchmarks_go_through_in_groups(spark, docs, monkeypatch, group, words):
    monkeypatch.setattr(decontaminate, "GROUP", group)
    monkeypatch.setattr(decontaminate, "WORDS", words)
    monkeypatch.setattr(decontaminate, "ITEMS", 10)
    monkeypatch.setattr(decontaminate, "VOCABULARY", 500)
    rng, text = language(4)
    items = [(i, " ".join(text(30))) for i in range(50)]
    data = [(i, " ".join([*text(40), *items[i][1].split(), *text(40)])) for i in range(50)] + [(100 + i, " ".join(text(100))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(data), bench).collect()} == {(i, i) for i in range(50)}
    assert {r.doc_id for r in decontaminate.keep_clean(docs(data), bench).collect()} == set(range(100, 130))


def test_a_benchmark_of_five_thousand_items(spark, docs):
    rng, text = language(5)
    items = [(i, " ".join(text(25))) for i in range(5000)]
    data = [(i, " ".join([*text(40), *items[i * 70][1].split(), *text(20)])) for i in range(70)] + [(100 + i, " ".join(text(100))) for i in range(30)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(data), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert {(i, i * 70) for i in range(70)} <= got and not {d for d, _ in got} & set(range(100, 130))


def test_columns_named_like_the_results(spark):
    bench = spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(20)))], "item_id bigint, text string")
    rows = spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(20)), 7, 0.5, "w"), (None, "clean", 8, 0.1, None)], "doc_id bigint, text string, item_id int, cosine double, word string")
    assert [tuple(r)[:2] for r in decontaminate.matches(rows, bench).collect()] == [(1, 1)]
    kept = decontaminate.keep_clean(rows, bench)
    assert kept.columns == rows.columns and [tuple(r) for r in kept.collect()] == [(None, "clean", 8, 0.1, None)]
