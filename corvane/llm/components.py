"""Connected components by alternating large and small stars (Kiveris et al., 2014), in DataFrames.

Both stars take a minimum per node, which combines before the shuffle, and join it
back; a node with very many edges is split by the adaptive skew join. Each round is
written to the shared folder, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import cut, let_go


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m")).select("_a", F.least("_m", "_a").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m"))
    pulled = down.join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pulled.unionByName(least.select(F.col("_a").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, root (least id of the component) for every id that edges (a, b) name; loops and repeats are allowed."""
    e = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    flat = e.isEmpty()
    while not flat:
        e = cut(_small(_large(e)), "stars")
        # the edges still join what they joined; once no end of one is the start of another, all are stars round their least ids
        flat = e.join(e.select(F.col("a").alias("_a")), F.col("b") == F.col("_a"), "left_semi").isEmpty()
    let_go(e.sparkSession)
    roots = e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root")).distinct()
