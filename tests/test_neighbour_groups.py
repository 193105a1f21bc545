"""Neighbours across groups of blocks: exact, and a block is not sent once for every other block."""

import numpy as np

from corvane.operators import vectors
from tests.test_audit import brute
from tests.test_operators import embeddings


def test_blocks_go_in_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(f"v{i:03d}", np.float32(rng.normal(size=6)).astype(float)) for i in range(300)] + [(f"t{i}", np.ones(6)) for i in range(9)]
    near = vectors.nearest(embeddings(spark, rows), 3, block=8)
    assert "FlatMapCoGroupsInArrow" in near._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.a, r.b, round(r.sim, 6), r.rank) for r in near.collect()) == brute(rows, 3)


def test_k_best_of_each(spark):
    import pyarrow as pa

    t = pa.table({"a": ["x", "y", "x", "x", "y"], "b": ["c", "d", "b", "a", "e"], "sim": [0.5, 0.1, 0.5, 0.2, 0.3]})
    assert vectors._first(t, 2).to_pylist() == [{"a": "x", "b": "b", "sim": 0.5}, {"a": "x", "b": "c", "sim": 0.5}, {"a": "y", "b": "e", "sim": 0.3}, {"a": "y", "b": "d", "sim": 0.1}]
    assert vectors._first(t.slice(0, 0), 2).num_rows == 0
