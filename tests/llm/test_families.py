"""Near duplicates in families that no single centre describes, against brute force."""

import numpy as np
import pytest

from corvane.llm import minhash


def brute(data, rule):
    """doc -> smallest doc it is linked with, over however many steps, by every pair's sets."""
    sets = {}
    for i, text in data:
        w = text.lower().split()
        k = min(rule.words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    names = sorted(sets)
    for x, i in enumerate(names):
        for j in names[x + 1 :]:
            a, b = root(i), root(j)
            both = len(sets[i] & sets[j])
            if a != b and 100 * both >= rule.percent * (len(sets[i]) + len(sets[j]) - both):
                at[max(a, b)] = min(a, b)
    return {i: root(i) for i in names}


def path_family(rng, words=300, half=200, between=100):
    """Two crowds at both ends of a path of edits, some near the first's, some near the second's, and one link across."""
    base = [f"b{k}" for k in range(words)]
    spots = rng.choice(np.arange(4, words - 4, 7), 40, replace=False)
    path, own = spots[:20], spots[20:]

    def text(edits, mark=None):
        w = list(base)
        for k in edits:
            w[path[k]] = f"p{k}"
        if mark is not None:
            w[own[mark % 20]] = f"own{mark}"
        return " ".join(w)

    docs = [text((), k) for k in range(half)] + [text(range(20), 1000 + k) for k in range(half)]
    docs += [text(rng.choice(14, rng.integers(4, 6), replace=False)) for _ in range(between)]
    docs += [text([*range(14), *rng.choice(np.arange(14, 20), rng.integers(1, 3), replace=False)]) for _ in range(between)]
    docs += [text(range(6)), text(range(14))]
    order = rng.permutation(len(docs))
    return [(int(i), t) for i, t in zip(order, docs)]


@pytest.mark.parametrize("block", [256, 60])
def test_two_crowds_joined_by_one_link(spark, docs, monkeypatch, block):
    """Several blocks to a bucket; the one link across joins neither crowd's centre."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rule, data = minhash.Rule(3, 85), path_family(np.random.default_rng(11))
    got = {r.doc_id: r.component_id for r in minhash.report(docs(data), rule).collect()}
    assert got == brute(data, rule)


def test_many_small_families_and_a_large_one(spark, docs):
    rng, rule = np.random.default_rng(12), minhash.Rule(5, 80)
    data = []
    for f in range(60):
        base = [f"f{f}w{k}" for k in range(int(rng.integers(20, 120)))]
        for _ in range(int(rng.integers(1, 6)) if f else 400):
            w = list(base)
            for k in rng.choice(len(w), int(rng.integers(0, 1 + len(w) // 25)), replace=False):
                w[k] = f"x{rng.integers(0, 10**6)}"
            data.append((len(data) * 7 % 5003, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash.report(docs(data), rule).collect()}
    assert got == brute(data, rule)


def test_one_word_more(spark, docs):
    """Sets of 6 and 7 shingles, 6 in common: a link that no band of mostly borrowed bins held."""
    words = "w1398404 w7557066 w6693112 w8778894 w6233753 w6468654 w3446781 w3103286"
    got = {r.doc_id: r.component_id for r in minhash.report(docs([(1, words), (2, f"{words} w6174919")]), minhash.Rule(3, 85)).collect()}
    assert got == {1: 1, 2: 1}


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_keys_of_small_sets_are_exact(percent):
    """Every pair at or just over the threshold, of all sizes that are found exactly and the first that are not, has a key in common."""
    rng, rule = np.random.default_rng(percent), minhash.Rule(3, percent)
    last = minhash.size_classes(percent)[-1][1]
    for n in range(rule.least, last + 30):
        pairs = []
        for gone in range(n):
            more = (100 * (n - gone)) // percent - n  # the most that keep the pair linked
            if more < 0:
                break
            u = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            pairs += [(np.sort(u), np.sort(np.concatenate([u[gone:], rng.integers(0, 1 << 64, k, dtype=np.uint64)]))) for k in {more, more // 2} if gone or k]
        for a, b in pairs:
            assert min(len(a), len(b)) < rule.least or set(minhash.keys_of([a], rule)[0]) & set(minhash.keys_of([b], rule)[0])


def test_loss_of_larger_sets():
    """Bands alone, from SMALL on: of 3,000 pairs at the threshold none is unseen."""
    rng, rule = np.random.default_rng(13), minhash.Rule(3, 85)
    for n in (110, 250, 511, 530):
        sets = []
        for _ in range(750):
            u = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            sets += [np.sort(u), np.sort(np.concatenate([u[: -(-85 * n // 100)], rng.integers(0, 1 << 64, 0, dtype=np.uint64)]))]
        keys = minhash.keys_of(sets, rule)
        assert all(set(a[-24:]) & set(b[-24:]) or set(a) & set(b) for a, b in zip(keys[::2], keys[1::2]))


def test_texts_of_one_id_in_any_order(spark, docs):
    """Rows that share a doc_id are one document with the links of all its texts; the order of rows changes nothing."""
    one, two, far = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    data = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (4, far), (4, far), (5, None), (5, far)]
    want = {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    for order in (data, data[::-1]):
        assert {(r.doc_id, r.component_id) for r in minhash.report(docs(order), minhash.Rule(3, 85)).collect()} == want
    assert sorted(r.doc_id for r in minhash.keep_first(docs(data), minhash.Rule(3, 85)).collect()) == [1, 1, 4, 4]
