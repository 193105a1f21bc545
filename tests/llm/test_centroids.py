"""Centroid clustering against plain Python integers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from corvane.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, distance string, v int"


def brute(rows, rule):
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 by the contract, one vector after the other."""
    kept = [(i, [math.floor(rule.scale * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == rule.width and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (hashlib.sha256(f"{rule.seed}:{r[0]}".encode()).hexdigest(), r[1])
    at = [v for _, v in sorted((r for r in kept if r[0] is not None), key=key)[: rule.k]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(at))

    for _ in range(rule.rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[near(v)[1]].append(v)
        at = [[sum(x) // len(x) for x in zip(*held[n])] if n in held else c for n, c in enumerate(at)]
    done = [(i, *near(v)[::-1]) for i, v in kept]
    sums = defaultdict(int)
    for _, c, d in done:
        sums[c] += d
    return sorted(((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, c, d in done), key=str)


def got(spark, rows, rule=centroids.Rule()):
    df = spark.createDataFrame([(i, e, 1, "x", "y", 2) for i, e in rows], SCHEMA)
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in centroids.report(df, rule).collect()), key=str)


def test_report_equals_plain_integers(spark):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(5, 64))
    rows = [(i, (middle[i % 5] * rng.choice([0.2, 1, 3]) + rng.normal(size=64) * 0.3).astype(float).tolist()) for i in range(300)]
    rows += [(i, rows[i][1]) for i in (1, 2, 2)] + [(500, [0.0] * 64), (None, [1.5] * 64)]
    odd = [(600, None), (601, []), (602, [1.0] * 63), (603, [1.0] * 65), (604, [None] + [1.0] * 63), (605, [float("nan")] + [0.0] * 63), (606, [float("-inf")] + [0.0] * 63)]
    assert got(spark, rows + odd) == brute(rows + odd, centroids.Rule())


def test_ties_and_few_vectors(spark):
    """Grid points at equal distances of centroids, all on one circle of norms; fewer vectors than centroids."""
    rows = [(i, [float((i >> k & 1) * 2 - 1) / 64 for k in range(3)]) for i in range(8)] * 3
    for k in (1, 2, 7, 16):
        rule = centroids.Rule(k=k, width=3)
        assert got(spark, rows, rule) == brute(rows, rule)
    assert got(spark, []) == [] and got(spark, [(1, [1.0])]) == []


def test_vectors_no_long_can_measure(spark):
    rows = [(1, [1e9] * 64), (2, [1.0] * 64), (3, [2.0] * 64)]
    far = [r for r in got(spark, rows) if r[0] == 1]
    assert far == [(1, None, None, None, None, None)]
    assert [r for r in got(spark, rows) if r[0] != 1] == brute(rows[1:], centroids.Rule())
    assert got(spark, rows[:1]) == far


@pytest.mark.parametrize("pairs", [1, 7, 1 << 16])
def test_annulus_holds_every_nearest(monkeypatch, pairs):
    """Against all distances; centroids of far apart norms are not compared."""
    monkeypatch.setattr(centroids, "PAIRS", pairs)
    rng = np.random.default_rng(7)
    for scale in (1, 50, 1 << 20):
        c = rng.integers(-scale, scale + 1, (40, 6)) * rng.integers(1, 60, (40, 1))
        c[7], c[9] = c[3], -c[3]
        x = np.concatenate([rng.integers(-scale, scale + 1, (200, 6)) * rng.integers(1, 60, (200, 1)), c, (c[1:] + c[:-1]) // 2])
        number, best, count = centroids.Annulus(c).nearest(x)
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (number == d.argmin(1)).all() and (best == d.min(1)).all() and count.min() >= 1
        assert count.mean() < 36 or scale == 1
