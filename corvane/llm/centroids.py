"""Centroid clustering with annulus search, in whole numbers.

Vectors become integers, floor(SCALE * x), and are written once. In each round the
centroids (k of them, a parameter) go to all tasks, sorted by norm. A vector's exact
distance to the centroids next to it in that order is an upper bound u of its
distance to the nearest; by the triangle inequality no centroid whose norm differs
from the vector's by more than u is as near. The others, an annulus, are found by
binary search and compared exactly; the annulus is widened by SLACK of the norms, so
that rounding of square roots never loses one, and keeps the ties on its boundary.
Tasks send one row of sums per cluster and batch, which combine before the shuffle;
k rows of sums reach the driver. No assignment is kept between rounds.

Defined cases: vectors of another width, with a null or a non-finite component are
left out; vectors with a component of LIMIT or more after scaling, whose squared
distances a long cannot hold, come out with null cluster and distances and move no
centroid; with fewer vectors than k there are as many centroids as vectors; starts
of equal hash (repeated ids) are ordered by their components, ids that are null start
no cluster; an empty cluster keeps its centroid; repeated rows count each; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import cut

LIMIT = 1 << 27
SLACK = 1e-9
ROWS, PAIRS = 4096, 1 << 16


@dataclass(frozen=True)
class Rule:
    k: int = 16
    rounds: int = 3
    width: int = 64
    scale: float = 64.0
    seed: int = 1


def scaled(vectors: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """vec_id, v (array of integers, null where one is LIMIT or more) of the vectors that are kept."""
    fit = (F.size("embedding") == rule.width) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.coalesce(fit, F.lit(False)))
    wide = F.exists("embedding", lambda c: F.abs(c.cast("double") * rule.scale) >= LIMIT)
    return x.select("vec_id", F.when(~wide, F.transform("embedding", lambda c: F.floor(c.cast("double") * rule.scale).cast("int"))).alias("v"))


def starts(kept: DataFrame, rule: Rule = Rule()) -> np.ndarray:
    """The first k vectors by the hash of their id."""
    key = F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.filter("v is not null and vec_id is not null").select(key.alias("h"), "v").orderBy("h", "v").limit(rule.k).collect()
    return np.array([r.v for r in rows], dtype=np.int64).reshape(-1, rule.width)


class Annulus:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids * centroids).sum(1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.at = norms[self.order], centroids[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance, centroids compared) of each row of x; the smaller number wins ties."""
        k, n = len(self.order), len(x)
        r = np.sqrt((x * x).sum(1).astype(np.float64))
        right = np.minimum(np.searchsorted(self.norms, r), k - 1)
        bound = np.minimum(self._distance(x, right), self._distance(x, np.maximum(right - 1, 0)))
        u = np.sqrt(bound.astype(np.float64))
        slack = SLACK * (r + u + 1)
        low = np.searchsorted(self.norms, r - u - slack, "left")
        count = np.searchsorted(self.norms, r + u + slack, "right") - low
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k, dtype=np.int64)
        ends = count.cumsum()
        a = 0
        while a < n:  # as many rows as make PAIRS comparisons
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            size = count[a:b]
            row = np.repeat(np.arange(a, b), size)
            first = size.cumsum() - size
            place = np.arange(len(row)) - np.repeat(first - low[a:b], size)
            d = self._distance(x[row], place)
            best[a:b] = np.minimum.reduceat(d, first)
            name = np.where(d == np.repeat(best[a:b], size), self.order[place], k)
            number[a:b] = np.minimum.reduceat(name, first)
            a = b
        return number, best, count

    def _distance(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        d = x - self.at[place]
        return (d * d).sum(1)


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with the matrix of their vectors."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            yield b, b.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, width)


def moved(kept: DataFrame, centroids: np.ndarray, rule: Rule) -> np.ndarray:
    """The centroids after one round: floors of exact means, empty clusters as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, sums, sizes = Annulus(centroids), np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for _, x in _rows(batches, rule.width):
            number, _, _ = near.nearest(x)
            order = np.argsort(number, kind="stable")
            held, first = np.unique(number[order], return_index=True)
            sums[held] += np.add.reduceat(x[order], first)
            sizes += np.bincount(number, minlength=len(sizes))
        held = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sizes[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = kept.filter("v is not null").select("v").mapInArrow(run, "cluster bigint, n bigint, sums array<bigint>")
    total = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(rule.width)]
    new = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():  # at most k rows
        new[r.cluster] = [r[f"s{i}"] // r.n for i in range(rule.width)]
    return new


def assigned(kept: DataFrame, centroids: np.ndarray, rule: Rule) -> DataFrame:
    """vec_id, cluster, distance, compared (centroids in the annulus) of every kept vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Annulus(centroids)
        for b, x in _rows(batches, rule.width):
            number, best, count = near.nearest(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(best), pa.array(count.astype(np.int32))], ["vec_id", "cluster", "distance", "compared"])

    schema = "vec_id bigint, cluster int, distance bigint, compared int"
    done = kept.filter("v is not null").mapInArrow(run, schema)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"), ("compared", "int"))]
    return done.unionByName(kept.filter("v is null").select("vec_id", *none))


def clusters(vectors: DataFrame, rule: Rule = Rule()) -> tuple[DataFrame, np.ndarray]:
    """(assigned() after all rounds, written once; the final centroids)."""
    kept = cut(scaled(vectors, rule), "vectors")
    centroids = starts(kept, rule)
    for _ in range(rule.rounds if len(centroids) else 0):
        centroids = moved(kept, centroids, rule)
    if not len(centroids):
        kept = kept.withColumn("v", F.lit(None).cast("array<int>"))  # without a start there is no cluster
        centroids = np.zeros((1, rule.width), dtype=np.int64)
    return cut(assigned(kept, centroids, rule), "clusters"), centroids


def report(vectors: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    done, centroids = clusters(vectors, rule)
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: int(r.s) for r in done.filter("cluster is not null").groupBy("cluster").agg(exact.alias("s")).collect()}  # at most k rows
    long = lambda x: x if x < 1 << 63 else None
    every = long(sum(sums.values()))
    rows = [(c, long(s), every, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())]
    table = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return done.drop("compared").join(F.broadcast(table), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rule: Rule) -> str:
    """The same in SQL, every vector against every centroid, component by component."""
    out = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({rule.scale:g} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {rule.width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {rule.width}),
comp AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range(1, {rule.width + 1})) AS i FROM kept),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{rule.seed}:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {rule.k})"""
    for n in range(rule.rounds + 1):
        out += f""",
p{n} AS MATERIALIZED (SELECT c, unnest(v) AS y, unnest(range(1, {rule.width + 1})) AS i FROM c{n}),
d{n} AS (SELECT r, c, sum((x - y) * (x - y))::BIGINT AS d FROM comp JOIN p{n} USING (i) GROUP BY r, c),
a{n} AS MATERIALIZED (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        if n < rule.rounds:
            out += f""",
m{n} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM comp JOIN a{n} USING (r) GROUP BY c, i),
f{n} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM m{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c, coalesce(f{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN f{n} USING (c))"""
    n = rule.rounds
    return (
        out
        + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{n}.v, ',')) AS centroid_sha256
FROM a{n} JOIN kept USING (r) JOIN c{n} USING (c)"""
    )


CLUSTER_SQL = _sql(Rule())
