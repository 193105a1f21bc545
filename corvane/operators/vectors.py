"""Cosine search and exact nearest neighbours.

All-pairs similarity is done in blocks: vectors are normalised, dealt to pivots (at
most PIVOTS, sampled) and packed into matrices of about BLOCK rows of one pivot; pairs
of blocks that the triangle inequality of angles cannot rule out are multiplied in
tasks, and only the best k rows per id leave a task, so neither side is ever held
whole and nothing is broadcast that grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions import text as T
from corvane.sources.shared import stored

BLOCK = 2048
DIGITS = 9  # similarities are ranked at this many digits, so that engines agree on ties


def of_model(embeddings: DataFrame, model: str) -> DataFrame:
    """Vectors of one model; comparisons never cross models."""
    return embeddings.filter(F.col("model") == model)


def check_width(embeddings: DataFrame, vector: list[float], model: str) -> None:
    """A model without vectors, or of another width than the query's, is an error."""
    widths = [r.dims for r in of_model(embeddings, model).select("dims").distinct().limit(2).collect()]
    if not widths:
        raise ValueError(f"no vectors of model {model}")
    if widths != [len(vector)]:
        raise ValueError(f"the query has {len(vector)} dimensions, model {model} has {widths}")


def semantic(embeddings: DataFrame, vector: list[float], model: str, floor: float = C.SEMANTIC_FLOOR) -> DataFrame:
    """source_kind, full_id, similarity of records whose cosine with vector is floor or more."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    return of_model(embeddings, model).select("source_kind", "full_id", T.cosine(F.col("vector"), query).alias("similarity")).filter(F.col("similarity") >= floor)


PIVOTS = 256
PACKED = "block bigint, kind int, ids array<string>, m binary, centre binary, radius double, low binary"


def _unit(column) -> tuple[np.ndarray, np.ndarray]:
    """(kind: the vector's width, 0 for a zero vector; rows of unit length or zeros) of an Arrow column of lists of one width each."""
    rows = [np.asarray(x.as_py() or [], dtype=np.float64) for x in column]
    norms = [float(np.sqrt(x @ x)) for x in rows]
    return np.array([len(x) if n > 0 else 0 for x, n in zip(rows, norms)], dtype=np.int32), [x / n if n > 0 else x[:0] for x, n in zip(rows, norms)]


def _pivots(vectors: DataFrame, block: int) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """(per width, at most PIVOTS unit vectors of lowest hash; rows per width). A model has one width, so this is small."""
    n = {r.w: r.n for r in vectors.groupBy(F.size("vector").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {}
    for w, many in n.items():
        k = min(PIVOTS, -(-many // block))
        rows = vectors.filter(F.size("vector") == w).orderBy(F.xxhash64("full_id"), "full_id").limit(k).select("vector").toArrow()
        kinds, units = _unit(rows.column("vector"))
        out[w] = np.array([u for k_, u in zip(kinds, units) if k_])
    return out, n


def _placed(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """full_id, kind, pivot (the nearest one's number), unit (the vector at unit length)."""

    def run(batches):
        for b in batches:
            kinds, units = _unit(b.column("vector"))
            at = np.zeros(len(kinds), dtype=np.int32)
            for w in set(kinds.tolist()) - {0}:
                own = np.flatnonzero(kinds == w)
                if len(pivots.get(w, ())):
                    at[own] = (np.array([units[i] for i in own]) @ pivots[w].T).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column("full_id"), pa.array(kinds), pa.array(at), pa.array([u.tobytes() for u in units], pa.binary())], ["full_id", "kind", "pivot", "unit"])

    return vectors.select("full_id", "vector").mapInArrow(run, "full_id string, kind int, pivot int, unit binary")


def _best(ids, ids2, sims, k):
    """The k best columns of each row, ties in the order of ids; sims of -inf are none."""
    order = np.argsort(ids2)
    ids2, sims = ids2[order], sims[:, order]
    best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    rows, cols = np.repeat(np.arange(len(ids)), best.shape[1]), best.ravel()
    value = sims[rows, cols]
    ok = np.isfinite(value)
    return pa.RecordBatch.from_arrays([pa.array(ids[rows[ok]], pa.string()), pa.array(ids2[cols[ok]], pa.string()), pa.array(value[ok])], ["a", "b", "sim"])


NONE = pa.schema([("a", pa.string()), ("b", pa.string()), ("sim", pa.float64())])


def _first(found: pa.Table, k: int) -> pa.Table:
    """Of each a the k best rows, ties in the order of b."""
    found = found.sort_by([("a", "ascending"), ("sim", "descending"), ("b", "ascending")]).combine_chunks()
    a = found.column("a")
    begins = np.flatnonzero(np.r_[True, pa.compute.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy()]) if len(a) else np.zeros(0, dtype=np.int64)
    return found.filter(pa.array(np.arange(len(a)) - np.repeat(begins, np.diff(np.r_[begins, len(a)])) < k))


def _matrix(ids, m) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(ids.as_py())
    return ids, np.frombuffer(m.as_buffer(), dtype=np.float64).reshape(len(ids), -1)


def _own(x: np.ndarray, y: np.ndarray, same: bool) -> np.ndarray:
    sims = np.round(x @ y.T, DIGITS)
    if same:
        np.fill_diagonal(sims, -np.inf)
    return sims


def _packed(placed: DataFrame, sizes: dict[tuple[int, int], int], k: int, floor: float, block: int) -> DataFrame:
    """PACKED: at most about `block` vectors of one pivot, their mean direction, the widest angle from it, and of each the k-th best similarity inside the block."""
    spark = placed.sparkSession
    parts, first = [], 0
    for (kind, pivot), n in sorted(sizes.items()):
        parts.append((kind, pivot, -(-n // block), first))
        first += -(-n // block)
    table = F.broadcast(spark.createDataFrame(parts, "kind int, pivot int, _parts int, _first bigint"))  # a row per pivot

    def run(t: pa.Table) -> pa.Table:
        ids = np.array(t.column("full_id").to_pylist())
        x = np.frombuffer(b"".join(t.column("unit").to_pylist()), dtype=np.float64).reshape(len(ids), -1)
        low, centre, radius = np.full(len(ids), -np.inf), np.zeros(x.shape[1]), np.pi
        if x.shape[1]:
            mean = x.sum(0)
            if (size := np.sqrt(mean @ mean)) > 1e-9:
                centre, radius = mean / size, float(np.arccos(np.clip(x @ (mean / size), -1, 1)).max())
            if len(ids) > k:
                sims = _own(x, x, True)
                low = np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k]
        low = np.maximum(low, floor) if floor > 0 else low
        one = lambda v: pa.array([v.tobytes()], pa.binary())
        return pa.table({"block": t.column("block").slice(0, 1), "kind": t.column("kind").slice(0, 1), "ids": pa.array([ids.tolist()], pa.list_(pa.string())), "m": one(x), "centre": one(centre), "radius": [radius], "low": one(low)})

    rows = placed.join(table, ["kind", "pivot"]).withColumn("block", F.col("_first") + F.pmod(F.xxhash64("full_id"), F.col("_parts")))
    return rows.select("block", "kind", "full_id", "unit").groupBy("block").applyInArrow(run, PACKED)


GROUP = 16  # blocks, at most, that go together where pairs of blocks are multiplied
HEADS = 512  # blocks whose bounds one task compares with another such group's


def _near_blocks(packed: DataFrame, blocks: int) -> DataFrame:
    """block, block2 (larger) of those pairs of blocks that may hold a pair as near as the k-th best of one of its ends.

    Two vectors are no nearer than their blocks' centres less both radii; a block asks for what its neediest vector does.
    """
    groups = -(-blocks // HEADS)

    def head(t: pa.Table) -> pa.Table:
        low = [float(np.frombuffer(x, dtype=np.float64).min()) for x in t.column("low").to_pylist()]
        return pa.table({"g": t.column("g").slice(0, 1), "blocks": [t.column("block").to_pylist()], "kinds": [t.column("kind").to_pylist()], "centres": [t.column("centre").to_pylist()], "radii": [t.column("radius").to_pylist()], "lows": [low]})

    cols = "blocks array<bigint>, kinds array<bigint>, centres array<binary>, radii array<double>, lows array<double>"
    heads = packed.select((F.col("block") % groups).cast("int").alias("g"), "block", "kind", "centre", "radius", "low").groupBy("g").applyInArrow(head, f"g int, {cols}")
    left = heads.withColumn("g2", F.explode(F.sequence("g", F.lit(groups - 1))))
    right = heads.select(F.col("g").alias("g2"), F.explode(F.sequence(F.lit(0), "g")).alias("g"), *[F.col(c.split()[0]).alias(c.split()[0] + "2") for c in cols.split(", ")])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                a, z = [], []
                for kind in set(r["kinds"]) & set(r["kinds2"]) - {0}:
                    i = [n for n, x in enumerate(r["kinds"]) if x == kind]
                    j = [n for n, x in enumerate(r["kinds2"]) if x == kind]
                    c, d = (np.array([np.frombuffer(r[name][n]) for n in some]) for name, some in (("centres", i), ("centres2", j)))
                    take = lambda name, some: np.array([r[name][n] for n in some])
                    gap = np.arccos(np.clip(c @ d.T, -1, 1)) - take("radii", i)[:, None] - take("radii2", j)[None, :]
                    bound = np.cos(np.clip(gap, 0, np.pi))
                    own, other = take("blocks", i)[:, None], take("blocks2", j)[None, :]
                    need = np.minimum(take("lows", i)[:, None], take("lows2", j)[None, :]) - SLACK
                    p, q = np.nonzero((bound >= need) & ((own < other) if r["g"] == r["g2"] else np.ones_like(bound, dtype=bool)))
                    a += np.minimum(own[p, 0], other[0, q]).tolist()
                    z += np.maximum(own[p, 0], other[0, q]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["block", "block2"])

    return left.join(right, ["g", "g2"]).mapInArrow(run, "block bigint, block2 bigint")


SLACK = 1e-6  # of similarities, for rounding and for arccos near 1


def nearest(vectors: DataFrame, k: int, floor: float = 0.0, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """a, b, sim, rank: the k nearest others of every full_id, ties by full_id; floor > 0 drops lower similarities.

    Vectors of one direction share blocks. A block's own product says how near its vectors' k-th best are at least; pairs of
    blocks whose centres lie too far apart for that are never multiplied, and in the others only the rows that may gain.
    Vectors of different widths, and zero vectors, have similarity 0: candidates are then the first ids of the others.
    With report, it is given the numbers of pairs of blocks, and of those that were multiplied.
    """
    pivots, _ = _pivots(vectors, block)
    placed = stored(_placed(vectors, pivots), "placed")
    sizes = {(r.kind, r.pivot): r.n for r in placed.groupBy("kind", "pivot").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per pivot
    packed = stored(_packed(placed, sizes, k, floor, block), "packed")
    blocks = sum(-(-n // block) for n in sizes.values())

    def inside(batches):
        for b in batches:
            for kind, ids, m in zip(b.column("kind"), b.column("ids"), b.column("m")):
                if kind.as_py():
                    ids, x = _matrix(ids, m)
                    sims = _own(x, x, True)
                    if floor > 0:
                        sims[sims < floor] = -np.inf
                    yield _best(ids, ids, sims, k)

    def across(pairs: pa.Table, held: pa.Table) -> pa.Table:
        cols = [held.column(c).combine_chunks() for c in ("ids", "m", "centre", "radius", "low")]
        at = {n: i for i, n in enumerate(held.column("block").to_pylist())}
        others: dict[int, list[int]] = {}
        for p, q in zip(pairs.column("block").to_pylist(), pairs.column("block2").to_pylist()):
            others.setdefault(at[p], []).append(at[q])
            others.setdefault(at[q], []).append(at[p])
        sides = [_matrix(ids, m) for ids, m in zip(cols[0], cols[1])]
        centres, lows = ([np.frombuffer(v.as_buffer(), dtype=np.float64) for v in c] for c in (cols[2], cols[4]))
        out = []
        for me, some in sorted(others.items()):
            (ids, x), parts = sides[me], []
            for it in some:
                ids2, y = sides[it]
                gap = np.arccos(np.clip(x @ centres[it], -1, 1)) - cols[3][it].as_py()
                rows = np.flatnonzero(np.cos(np.clip(gap, 0, np.pi)) >= lows[me] - SLACK)
                if len(rows):
                    sims = _own(x[rows], y, False)
                    sims[sims < lows[me][rows, None] - SLACK] = -np.inf
                    if floor > 0:
                        sims[sims < floor] = -np.inf
                    parts.append(_best(ids[rows], ids2, sims, k))
            if parts:
                out.append(_first(pa.Table.from_batches(parts), k))
        return pa.concat_tables(out) if out else NONE.empty_table()

    found = packed.select("kind", "ids", "m").mapInArrow(inside, "a string, b string, sim double")
    pairs = stored(_near_blocks(packed, blocks), "block-pairs") if blocks > 1 else None
    if report is not None:
        report |= {"pairs": blocks * (blocks - 1) // 2, "multiplied": pairs.count() if pairs is not None else 0}
    if pairs is not None:
        # a block goes once to each two groups of blocks, and no more than k of a vector's others leave those
        size = max(1, min(GROUP, blocks // 8))
        cells = pairs.withColumn("g", F.expr(f"block div {size}")).withColumn("g2", F.expr(f"block2 div {size}"))
        asked = cells.select(F.col("g").alias("h"), F.col("g2").alias("h2"), F.explode(F.array("block", "block2")).alias("block")).distinct()
        held = asked.hint("merge").join(packed.select("block", "ids", "m", "centre", "radius", "low"), "block")
        found = found.unionByName(cells.groupBy("g", "g2").cogroup(held.groupBy("h", "h2")).applyInArrow(across, "a string, b string, sim double"))
    kinds = sorted({kind for kind, _ in sizes})
    if floor <= 0 and (len(kinds) > 1 or kinds == [0]):
        ids = placed.select("full_id", "kind")
        heads = [r for w in kinds for r in ids.filter(F.col("kind") == w).orderBy("full_id").limit(k + 1).collect()]  # k + 1 ids a width
        table = F.broadcast(placed.sparkSession.createDataFrame([(r.full_id, r.kind) for r in heads], "b string, _k int"))
        other = (F.col("kind") != F.col("_k")) | ((F.col("kind") == 0) & (F.col("full_id") != F.col("b")))
        found = found.unionByName(ids.join(table, other).select(F.col("full_id").alias("a"), "b", F.lit(0.0).alias("sim")))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def with_units(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs with _va, _vb: both ends' vectors at unit length (a zero vector as it is), made once a vector; null where there is none."""
    v = F.transform("vector", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.select("full_id", F.transform(v, lambda x: x / F.when(norm > 0, norm).otherwise(1.0)).alias("_u"))
    return pairs.join(unit.select(F.col("full_id").alias("a"), F.col("_u").alias("_va")), "a", "left").join(unit.select(F.col("full_id").alias("b"), F.col("_u").alias("_vb")), "b", "left")


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with sim; null where either side has no vector."""
    dot = F.aggregate(F.zip_with("_va", "_vb", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    sim = F.when(F.col("_va").isNotNull() & F.col("_vb").isNotNull(), F.when(F.size("_va") == F.size("_vb"), F.round(dot, DIGITS)).otherwise(0.0))
    return with_units(pairs, vectors).withColumn("sim", sim).drop("_va", "_vb")
