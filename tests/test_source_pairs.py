"""What the pairs of a source take on disk, and blocks of every size."""

import os

import pytest

from corvane.operators import audit


def test_pairs_take_a_fraction_of_a_byte(spark, tmp_path):
    rows = [(f"doc/en/{i * 7919 % 100_000}", "one") for i in range(3000)]
    audit.source_pairs(spark.createDataFrame(rows, "full_id string, source_file string")).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3000 * 2999 // 2
    assert sum(os.path.getsize(f"{tmp_path}/out/{f}") for f in os.listdir(tmp_path / "out")) < 0.6 * 3000 * 2999 / 2


@pytest.mark.parametrize("part, run", [(1, 1), (5, 2), (64, 64)])
def test_every_pair_once(spark, monkeypatch, part, run):
    monkeypatch.setattr(audit, "PART", part)
    monkeypatch.setattr(audit, "RUN", run)
    rows = [(f"s{i}", ["x", "y", "z", "", None][i % 5]) for i in range(120)] + [("s0", "x"), (None, "x"), (None, "alone"), ("one", "only")]
    got = [(r.a, r.b) for r in audit.source_pairs(spark.createDataFrame(rows, "full_id string, source_file string")).collect()]
    named = {(a, s) for a, s in rows if a and s}
    assert sorted(got) == sorted((a, b) for a, s in named for b, z in named if s == z and a < b)
