"""Pruned neighbours and the audit's first page against the plain ways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.operators import audit, vectors
from tests.test_operators import edges, embeddings, statements


def brute(rows, k, floor=0.0):
    out = []
    for a, x in rows:
        cos = lambda y: 0.0 if len(x) != len(y) or not np.any(x) or not np.any(y) else float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))  # noqa: B023, E731
        sims = sorted((-round(cos(y), 9), b) for b, y in rows if b != a)
        out += [(a, b, round(-s, 6), i + 1) for i, (s, b) in enumerate(s for s in sims if floor <= 0 or -s[0] >= floor) if i < k]
    return sorted(out)


def found(spark, rows, k, floor=0.0, block=16):
    report = {}
    near = vectors.nearest(embeddings(spark, rows), k, floor, block, report)
    return sorted((r.a, r.b, round(r.sim, 6), r.rank) for r in near.collect()), report


def test_pruned_neighbours_are_exact(spark):
    """Tight clusters, so that most pairs of blocks are ruled out; every vector's neighbours are those of all pairs."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 24))
    rows = [(f"v{i:03d}", np.float32(middle[i % 12] + rng.normal(size=24) * 0.08).astype(float)) for i in range(260)]
    got, report = found(spark, rows, 3)
    assert got == brute(rows, 3)
    assert report["multiplied"] < report["pairs"] / 2
    got, _ = found(spark, rows, 2, 0.99)
    assert got == brute(rows, 2, 0.99)


@pytest.mark.parametrize("block", [4, 2048])
def test_neighbours_of_other_widths_and_zeros(spark, block):
    """No direction in common, ties, zero vectors and vectors of another width, which are at 0 from all others."""
    rng = np.random.default_rng(4)
    rows = [(f"v{i:02d}", np.float32(rng.normal(size=5)).astype(float)) for i in range(20)] + [(f"t{i}", np.array([1.0, 0, 0, 0, 0])) for i in range(4)]
    rows += [("z1", np.zeros(5)), ("a1", np.zeros(5)), ("w1", np.ones(3)), ("w2", -np.ones(3)), ("w3", np.array([1.0, 2, 3]))]
    assert found(spark, rows, 4, block=block)[0] == brute(rows, 4)
    assert found(spark, rows[-4:-3], 2)[0] == [] and found(spark, rows[-5:-3], 2)[0] == brute(rows[-5:-3], 2)


@pytest.mark.parametrize("part, limit", [(2048, 50), (7, 10), (7, 500)])
def test_first_page_is_the_queues(spark, monkeypatch, part, limit):
    """Sources large and small, statements without a vector, ties, judged pairs and shared identifiers."""
    monkeypatch.setattr(audit, "PART", part)
    rng = np.random.default_rng(5)
    names, vec = [f"a/s{i:02d}" for i in range(60)], []
    for i, n in enumerate(names):
        if i % 9:
            vec.append((n, np.float32(rng.normal(size=4) if i % 4 else [1, 0, 0, 0]).astype(float)))
    mods = [None, "must", "must_not", "should"]
    s = statements(spark, [(n, f"body {i}", {"modality": mods[i % 4], "source": ["f", "g", "h", None, ""][i % 5] if i < 50 else "f"}) for i, n in enumerate(names)])
    facets = spark.createDataFrame([("statement", names[i], f"x_{i % 17}") for i in range(0, 60, 2)], "source_kind string, full_id string, facet string")
    e = edges(spark, [(names[i], names[(i * 7 + 3) % 60], "refines") for i in range(0, 60, 4)] + [(names[5], names[0], "duplicates")])
    v = spark.createDataFrame([(names[i], names[i + 5]) for i in range(0, 50, 3)], "a string, b string")
    args = (s, facets, embeddings(spark, vec), e, v, "m")
    queue, progress = audit.audit(*args)
    want = [tuple(r) for r in audit.page(queue, limit).collect()]
    assert [tuple(r) for r in audit.first_page(*args, limit=limit).collect()] == want and len(want) == min(limit, queue.count())
    if limit == 10:
        assert audit.progress(*args).collect() == progress.collect()
        few = s.limit(0)
        assert audit.first_page(few, *args[1:]).collect() == [] and tuple(audit.progress(few, *args[1:]).first()) == (0, 0, 0, 2)


def test_the_queue_in_blocks_is_the_joined_one(spark, monkeypatch):
    """Pairs of one source scored block by block against the window joined pair by pair: several blocks, judged pairs, no, zero and wider vectors; what is told stays with its end."""
    monkeypatch.setattr(audit, "PART", 7)
    monkeypatch.setattr(audit, "ROWS", 9)
    rng = np.random.default_rng(6)
    names = [f"a/s{i:02d}" for i in range(50)]
    vec = [(n, np.zeros(4) if i == 7 else np.float32(rng.normal(size=3 if i == 8 else 4)).astype(float)) for i, n in enumerate(names) if i % 6]
    mods = [None, "must", "must_not", "should"]
    s = statements(spark, [(n, f"body {i}", {"modality": mods[i % 4], "source": ["f", "f", "g", None, ""][i % 5]}) for i, n in enumerate(names)])
    facets = spark.createDataFrame([("statement", names[i], f"x_{i % 13}") for i in range(0, 50, 2)], "source_kind string, full_id string, facet string")
    e = edges(spark, [(names[i], names[(i * 7 + 5) % 50], "refines") for i in range(0, 50, 3)] + [(names[5], names[0], "duplicates")])
    v = spark.createDataFrame([(names[i], names[i + 5]) for i in range(0, 45, 4)], "a string, b string")
    told = s.select("full_id", F.concat(F.lit("t:"), "full_id").alias("told"))
    swept = audit.scope(s)
    vectors_ = audit.swept_vectors(embeddings(spark, vec), swept, "m")
    near = vectors.nearest(vectors_, C.DENSITY_K)
    for floor in (0.0, 0.6):
        chosen = vectors.nearest(vectors_, 2, floor)
        window = audit.window_pairs(facets, swept, chosen, 2).join(audit.adjudicated(e, v), ["a", "b"], "left_anti")
        want = sorted(map(repr, (tuple(r) for r in audit.score(window, swept, vectors_, near).collect())))
        queue = audit.audit(s, facets, embeddings(spark, vec), e, v, "m", floor=floor, told=told)[0]
        got = sorted(map(repr, (tuple(r) for r in queue.drop("told_a", "told_b").collect())))
        assert got == want and len(want) > 200
        assert queue.filter("told_a <> concat('t:', a) or told_b <> concat('t:', b)").count() == 0


def test_rows_that_cannot_reach_the_page_are_dealt_nowhere(spark):
    """Only statements that some pair of their source may bring to the least score are sent to blocks; at it, they are."""
    rows = spark.createDataFrame([("n", None), ("x", 0.1), ("y", 0.9), ("z", -0.4)], "full_id string, density double")
    near = spark.createDataFrame([("x", "y", 0.9, 1), ("y", "x", 0.9, 1), ("z", "x", -0.1, 1)], "a string, b string, sim double, rank int")
    kept = lambda least: sorted(r.full_id for r in audit._may_reach(rows, near, least).collect())
    assert kept(-np.inf) == kept(5.0) == ["n", "x", "y", "z"]
    assert kept(5.6) == ["x", "y", "z"] and kept(7.1) == ["x"] and kept(7.2) == []


def test_source_pairs_keep_their_tasks(spark):
    """One large source is paired in many tasks, though little is shuffled: adaptive execution may not make them one."""
    rows = [(f"s{i:04d}", "one" if i % 3 else "two") for i in range(600)] + [("null", None), ("none", "")]
    pairs = audit.source_pairs(spark.createDataFrame(rows, "full_id string, source_file string"))
    assert len({r.p for r in pairs.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 3
    want = {(a, b) for a, s in rows[:600] for b, z in rows[:600] if s == z and a < b}
    got = [(r.a, r.b) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want)
