"""SimHash groups against every pair of fingerprints."""

import re

import numpy as np
import pytest
import xxhash

from corvane.llm import simhash


def print_of(text):
    """One bit after the other, from the contract."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    said = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in said]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(prints):
    """doc -> smallest doc that can be reached over links, by every pair."""
    ids = [i for i, _ in prints]
    at = {k: k for k in range(len(prints))}

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    for x in range(len(prints)):
        for y in range(x + 1, len(prints)):
            if (prints[x][1] ^ prints[y][1]).bit_count() <= 4 and (p := root(x)) != (q := root(y)):
                at[max(p, q)] = min(p, q)
    least = {}
    for k in range(len(prints)):
        if ids[k] is not None:
            least[root(k)] = min(least.get(root(k), ids[k]), ids[k])
    return sorted(((ids[k], f"{prints[k][1]:016x}", least.get(root(k))) for k in range(len(prints))), key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "fingerprint", "component_id")) for r in df.collect()), key=str)


def test_fingerprints_bit_by_bit(odd):
    texts = [t for _, t in odd] + ["One two three four FIVE", "a\x0bb\x0cc d\x85e", "x y z", "w " * 20_000]
    assert [simhash.fingerprint(t) for t in texts] == [print_of(t) for t in texts]


def families(rng, n=500):
    base = [f"w{k}" for k in range(3000)]
    out = []
    for f in range(n // 10):
        own = list(rng.choice(base, int(rng.integers(30, 400))))
        for _ in range(10):
            w = list(own)
            for k in rng.choice(len(w), int(rng.integers(0, 2)), replace=False):
                w[k] = "new"
            out.append(" ".join(w))
    return [(int(i), t) for i, t in zip(rng.permutation(len(out)), out)]


def test_report_equals_every_pair(spark, docs, odd):
    rows = families(np.random.default_rng(4)) + [(1000 + i, t) for i, t in odd] + [(None, "no id"), (None, None), (-5, "no id")]
    want = brute([(i, print_of(t)) for i, t in rows])
    assert len({c for *_, c in want}) < len(want) - 100
    assert got(simhash.report(docs(rows))) == want
    assert got(simhash.report(docs([]))) == []


@pytest.mark.parametrize("bucket, slice_", [(1 << 24, 1 << 22), (1 << 24, 1 << 10), (100, 1 << 9)])
def test_links_lose_no_pair(spark, monkeypatch, bucket, slice_):
    """Prints at 0 to 6 bits of random ones, chains of steps of 4 and a crowd in one ball, in one slice a bucket, in several, and in more buckets."""
    rng = np.random.default_rng(5)
    prints = set(rng.integers(0, 1 << 63, 60, dtype=np.uint64).tolist())
    flip = lambda p, n: p ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False))
    for p in sorted(prints):
        prints |= {flip(p, int(n)) for n in rng.integers(1, 7, 5)}
    at = 0
    for _ in range(40):
        prints.add(at := flip(at, 4))
    prints |= {flip(1 << 60, int(n)) for n in rng.integers(0, 4, 300)}
    code = simhash.Code
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "SLICE", slice_)
    made = code(len(prints), 2)
    x = np.array(sorted(prints), dtype=np.uint64)
    pairs = set()
    for target in range(1 << (made.low + made.high)):
        mine = x[(made.buckets(x) == target % (1 << made.low)).any(axis=1)]
        a, b = simhash._collisions(mine[np.argsort(made(mine), kind="stable")], made, target)
        assert (np.bitwise_count(a ^ b) <= 4).all()
        pairs |= set(zip(a.tolist(), b.tolist()))
    at = {p: p for p in prints}

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    for p, q in pairs:
        if (s := root(p)) != (t := root(q)):
            at[max(s, t)] = min(s, t)
    want = brute([(int(p), int(p)) for p in x])
    assert sorted(((p, f"{p:016x}", root(p)) for p in prints), key=str) == want
