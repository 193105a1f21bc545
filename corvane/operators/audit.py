"""The audit sweep: pairs from shared identifiers, shared sources and nearest neighbours, CSLS order, a queue that drains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions import text as T
from corvane.operators import vectors as V
from corvane.sources.shared import stored

PART = 2048  # statements of one source in a block
RUN = 256  # ids that are written after each id of another block
TASKS = 4096  # at most, over which pairs of blocks are dealt
ROWS = 1 << 16  # pairs that leave a task at once


def scope(statements: DataFrame, namespace: str | None = None) -> DataFrame:
    """The statements that are swept: searchable, in the namespace. Rejections never are."""
    return statements.filter(T.searchable(F.col("status")) & T.in_namespace(F.col("namespace"), namespace))


def facet_pairs(facets: DataFrame, swept: DataFrame) -> DataFrame:
    """a < b and the identifiers both name, each held by 2 to FACET_HUB swept statements (so no hub makes pairs)."""
    own = facets.filter(F.col("source_kind") == "statement").join(swept.select("full_id"), "full_id", "left_semi").select("facet", "full_id")
    held = own.groupBy("facet").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, C.FACET_HUB)).select("facet")
    few = own.join(held, "facet")
    other = few.select("facet", F.col("full_id").alias("b"))
    return few.withColumnRenamed("full_id", "a").join(other, "facet").filter("a < b").groupBy("a", "b").agg(F.array_sort(F.collect_set("facet")).alias("shared_facets"))


def _id_blocks(own: DataFrame) -> DataFrame:
    """source_file, block, ids: at most PART sorted ids of one source that follow each other."""
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = own.repartitionByRange(tasks, "source_file", "full_id").sortWithinPartitions("source_file", "full_id").withColumn("block", F.expr(f"monotonically_increasing_id() div {PART}"))
    return row.groupBy("source_file", "block").agg(F.array_sort(F.collect_list("full_id")).alias("ids"))


def source_pairs(swept: DataFrame) -> DataFrame:
    """a < b of one non-empty source file. The operator's answer is every such pair; narrow the scope before asking.

    Ids lie in sorted blocks, and what is shuffled is a row for two blocks. A task writes RUN ids b after each a, the same for every
    a of a block, which files hold as little more than one run: the pairs take a fraction of a byte each, and no task a large source alone.
    """
    own = swept.filter((F.col("source_file") != "") & F.col("full_id").isNotNull()).select("source_file", "full_id").distinct()
    blocks = stored(_id_blocks(own), "source-blocks")
    ends = blocks.select("source_file", "block", F.col("ids")[0].alias("first"), F.element_at("ids", -1).alias("last"))
    side = lambda x: ends.select("source_file", F.col("block").alias(f"_{x}"), F.col("first").alias(f"_first_{x}"), F.col("last").alias(f"_last_{x}"))
    cells = stored(side("a").join(side("b"), "source_file").filter("_first_a < _last_b").select("source_file", "_a", "_b"), "source-cells")
    ids = lambda x: blocks.select("source_file", F.col("block").alias(f"_{x}"), F.col("ids").alias(f"_ids_{x}"))
    both = cells.hint("merge").join(ids("a"), ["source_file", "_a"]).hint("merge").join(ids("b"), ["source_file", "_b"])
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(max(tasks, min(cells.count(), TASKS)), "source_file", "_a", "_b")  # a cell is few bytes and many pairs, so its size must not decide how many a task takes
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_ids_b") - 1) / RUN).cast("int")), lambda i: F.slice("_ids_b", i * RUN + 1, RUN))
    rows = both.select("_ids_a", F.explode(runs).alias("_run")).select(F.explode("_ids_a").alias("a"), "_run")
    return rows.select("a", F.explode(F.when(F.col("a") < F.col("_run")[0], F.col("_run")).otherwise(F.filter("_run", lambda b: b > F.col("a")))).alias("b"))


def swept_vectors(embeddings: DataFrame, swept: DataFrame, model: str) -> DataFrame:
    return V.of_model(embeddings, model).filter(F.col("source_kind") == "statement").join(swept.select("full_id"), "full_id", "left_semi")


def knn_pairs(near: DataFrame, neighbours: int) -> DataFrame:
    """a < b where either is among the other's nearest."""
    return near.filter(F.col("rank") <= neighbours).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def density(near: DataFrame) -> DataFrame:
    """full_id, density: mean similarity of its DENSITY_K nearest in scope."""
    return near.filter(F.col("rank") <= C.DENSITY_K).groupBy(F.col("a").alias("full_id")).agg(F.avg("sim").alias("density"))


def adjudicated(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """a < b of judged pairs: edges of any type, in either direction, and verdicts."""
    e = edges.select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b"))
    return e.unionByName(verdicts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def window_pairs(facets: DataFrame, swept: DataFrame, near: DataFrame, neighbours: int) -> DataFrame:
    """a, b, shared_facets, same_source: every pair that some statement answers for, judged or not."""
    none = F.lit(None).cast("array<string>")
    parts = [
        facet_pairs(facets, swept).select("a", "b", "shared_facets", F.lit(False).alias("same_source")),
        source_pairs(swept).select("a", "b", none.alias("shared_facets"), F.lit(True).alias("same_source")),
        knn_pairs(near, neighbours).select("a", "b", none.alias("shared_facets"), F.lit(False).alias("same_source")),
    ]
    all_ = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return all_.groupBy("a", "b").agg(F.coalesce(F.max("shared_facets"), F.array().cast("array<string>")).alias("shared_facets"), F.bool_or("same_source").alias("same_source"))


def score(pairs: DataFrame, swept: DataFrame, vectors: DataFrame, near: DataFrame) -> DataFrame:
    """Unordered candidates with similarity (null: not measured), score, modality_conflict."""
    r = density(near)
    m = swept.select("full_id", "modality")
    side = lambda x: m.join(r, "full_id", "left").select(F.col("full_id").alias(x), F.col("modality").alias(f"_m{x}"), F.col("density").alias(f"_r{x}"))
    p = V.pair_similarity(pairs, vectors).join(side("a"), "a").join(side("b"), "b")
    near_part = F.when(F.col("sim").isNull(), F.lit(0.0)).otherwise(2 * F.col("sim") - F.coalesce("_ra", F.lit(0.0)) - F.coalesce("_rb", F.lit(0.0)))
    total = near_part + C.FACET_BOOST * F.size("shared_facets") + F.when(F.col("same_source"), C.SOURCE_BOOST).otherwise(0.0)
    return p.select("a", "b", F.round(total, 8).alias("score"), F.col("sim").alias("similarity"), "shared_facets", "same_source", T.modality_conflict(F.col("_ma"), F.col("_mb")).alias("modality_conflict"))


def audit(statements: DataFrame, facets: DataFrame, embeddings: DataFrame, edges: DataFrame, verdicts: DataFrame, model: str, namespace: str | None = None, neighbours: int = C.AUDIT_NEIGHBOURS, floor: float = 0.0, told: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the whole queue, unordered; progress: remaining, swept, statements, depth). told (full_id, told: string) adds told_a and told_b to the queue.

    Pairs of one source, which grow with the square of its size, are made and scored in blocks and never shuffled; the lists of
    identifiers and neighbours, which grow with the records, are joined.
    """
    swept = scope(statements, namespace).select("full_id", "namespace", "status", "modality", "source_file")
    vectors = stored(swept_vectors(embeddings, swept, model), "audit-vectors")
    near = stored(V.nearest(vectors, max(neighbours, C.DENSITY_K)), "audit-near")
    chosen = near.filter(F.col("sim") >= floor) if floor > 0 else near  # the first of these are the nearest at or above the floor
    judged = stored(adjudicated(edges, verdicts), "audit-judged")
    lists = stored(_linear_pairs(facets, swept, chosen, neighbours).join(judged, ["a", "b"], "left_anti"), "audit-lists")
    queue = score(lists, swept, vectors, near)
    names = [F.col("full_id").alias("a"), F.col("told").alias("told_a")], [F.col("full_id").alias("b"), F.col("told").alias("told_b")]
    if told is not None:
        queue = queue.join(told.select(*names[0]), "a", "left").join(told.select(*names[1]), "b", "left")
    apart = judged.unionByName(lists.filter("same_source").select("a", "b"))
    rest = _source_queue(swept, vectors, near, apart, told)
    queue = queue.select(*rest.columns).unionByName(rest)
    # the window stands before adjudication; a statement is swept when nothing in its window is unjudged
    window = window_pairs(facets, swept, chosen, neighbours)
    open_pairs = window.select("a", "b").join(judged, ["a", "b"], "left_anti")
    busy = open_pairs.select(F.explode(F.array("a", "b")).alias("full_id")).distinct()
    done = swept.join(busy, "full_id", "left_anti").agg(F.count(F.lit(1)).alias("swept"))
    progress = open_pairs.agg(F.count(F.lit(1)).alias("remaining")).crossJoin(done).crossJoin(swept.agg(F.count(F.lit(1)).alias("statements"))).withColumn("depth", F.lit(neighbours))
    return queue, progress


BLOCK_ROWS = "source_file string, part int, ids array<string>, told array<string>, sign binary, density binary, at binary, width binary, m binary"


def _packed(rows: DataFrame) -> DataFrame:
    """BLOCK_ROWS: the statements of a source's part as one row; `at` and `width` say where in `m` a unit vector stands (width -1: none)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("full_id")
        units = [None if v is None else np.asarray(v, dtype=np.float64) for v in t.column("vector").to_pylist()]
        units = [v if v is None or not v.any() else v / np.sqrt(v @ v) for v in units]
        width = np.array([-1 if v is None else len(v) for v in units], dtype=np.int64)
        at = np.cumsum(np.maximum(width, 0)) - np.maximum(width, 0)
        m = np.concatenate([v for v in units if v is not None] or [np.zeros(0)])
        held = lambda name, kind: np.array([x or 0 for x in t.column(name).to_pylist()], dtype=kind)
        one = lambda v: pa.array([v.tobytes()], pa.binary())
        return pa.table({
            "source_file": t.column("source_file").slice(0, 1), "part": t.column("part").slice(0, 1), "ids": pa.array([t.column("full_id").to_pylist()], pa.list_(pa.string())), "told": pa.array([t.column("told").to_pylist()], pa.list_(pa.string())),
            "sign": one(held("sign", np.int64)), "density": one(held("density", np.float64)), "at": one(at), "width": one(width), "m": one(m),
        })

    return rows.select("source_file", "part", "full_id", "told", "sign", "density", "vector").groupBy("source_file", "part").applyInArrow(run, BLOCK_ROWS)


def _source_queue(swept: DataFrame, vectors: DataFrame, near: DataFrame, apart: DataFrame, told: DataFrame | None) -> DataFrame:
    """The queue's rows of all pairs of one source but those apart (a, b).

    Statements of a source are dealt over parts of about PART, a part is one row, and a pair of parts one product. What leaves it
    is no shuffle's: a row of ids apart goes to its pair of parts, and the pairs themselves go where the queue goes, ROWS at a time.
    """
    sized = swept.filter("source_file is not null and source_file <> ''").select("full_id", "source_file", T.modality_sign(F.col("modality")).alias("sign"))
    parts = sized.groupBy("source_file").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    rows = sized.join(parts, "source_file").withColumn("part", F.pmod(F.xxhash64("full_id"), F.col("parts")).cast("int"))
    rows = rows.join(density(near), "full_id", "left").join(vectors.select("full_id", "vector"), "full_id", "left")
    rows = rows.join(told.select("full_id", "told"), "full_id", "left") if told is not None else rows.withColumn("told", F.lit(None).cast("string"))
    packed = stored(_packed(rows), "audit-parts")
    at = sized.join(parts, "source_file").select("full_id", "source_file", F.pmod(F.xxhash64("full_id"), F.col("parts")).cast("int").alias("part"))
    ends = apart.join(at.select(F.col("full_id").alias("a"), "source_file", F.col("part").alias("_p")), "a").join(at.select(F.col("full_id").alias("b"), F.col("source_file").alias("_s"), F.col("part").alias("_q")), "b").filter("source_file = _s and a <> b")
    off = ends.groupBy("source_file", F.least("_p", "_q").alias("i"), F.greatest("_p", "_q").alias("j")).agg(F.collect_list("a").alias("off_a"), F.collect_list("b").alias("off_b"))  # of two parts
    pairs = parts.select("source_file", F.col("parts"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i")).select("source_file", "i", F.explode(F.sequence("i", F.col("parts") - 1)).alias("j"))
    cells = pairs.join(off, ["source_file", "i", "j"], "left")
    side = lambda key, sign: packed.select("source_file", F.col("part").alias(key), *[F.col(c).alias(c + sign) for c in ("ids", "told", "sign", "density", "at", "width", "m")])
    many = parts.agg(F.expr("coalesce(sum(parts * (parts + 1) div 2), 0)").alias("n")).first().n
    cells = cells.hint("merge").join(side("i", "1"), ["source_file", "i"]).hint("merge").join(side("j", "2"), ["source_file", "j"])
    cells = cells.repartition(max(1, min(int(many), TASKS)), "source_file", "i", "j")  # a cell is few bytes and many pairs, so its size must not decide how many a task takes
    kinds = "a string, b string, total double, sim double, conflict boolean" + (", told_a string, told_b string" if told is not None else "")
    with_told = told is not None

    def read(r: dict, sign: str):
        of = lambda name, kind: np.frombuffer(r[name + sign], dtype=kind)
        return pa.array(r["ids" + sign], pa.string()), pa.array(r["told" + sign], pa.string()), of("sign", np.int64), of("density", np.float64), of("at", np.int64), of("width", np.int64), of("m", np.float64)

    def run(batches):
        for b in batches:
            for r in (x for k in range(b.num_rows) for x in b.slice(k, 1).to_pylist()):
                x, y = read(r, "1"), read(r, "2")
                number = lambda s: {i: n for n, i in enumerate(s[0].to_pylist())}
                left, right = number(x), number(y)
                away: dict[int, list[int]] = {}
                for p, q in zip(r["off_a"] or [], r["off_b"] or []):
                    for u, v in ((p, q), (q, p)):
                        if u in left and v in right:
                            away.setdefault(left[u], []).append(right[v])
                stacked = {w: (np.flatnonzero(y[5] == w), y[6][y[4][y[5] == w][:, None] + np.arange(w)]) for w in set(y[5].tolist()) - {-1}}
                step = max(1, ROWS // max(1, len(right)))
                names = np.array(y[0].to_pylist()), np.array(x[0].to_pylist())
                for k in range(0, len(left), step):
                    own = np.arange(k, min(k + step, len(left)))
                    shape = len(own), len(right)
                    take = np.ones(shape, dtype=bool) if r["i"] != r["j"] else own[:, None] < np.arange(len(right))[None, :]
                    for u in own.tolist():
                        take[u - k, away.get(u, [])] = False
                    sim = np.where((x[5][own] >= 0)[:, None] & (y[5] >= 0)[None, :], 0.0, np.nan)  # vectors of two widths are at 0
                    for w, (cols, m) in stacked.items():
                        some = np.flatnonzero(x[5][own] == w)
                        if len(some) and w:
                            sim[np.ix_(some, cols)] = np.round(x[6][x[4][own[some]][:, None] + np.arange(w)] @ m.T, V.DIGITS)
                    p, q = np.nonzero(take)
                    s = sim[p, q]
                    none = np.isnan(s)
                    first = names[1][own[p]] < names[0][q]
                    rho = x[3][own[p]], y[3][q]
                    total = np.where(none, 0.0, 2 * s - np.where(first, *rho) - np.where(first, *rho[::-1])) + C.SOURCE_BOOST  # a's first: sums of doubles have an order
                    turned = lambda u, v: pa.compute.if_else(pa.array(first), u, v)  # noqa: B023, E731
                    p, q = pa.array(own[p]), pa.array(q)
                    one, two = x[0].take(p), y[0].take(q)
                    out = [turned(one, two), turned(two, one), pa.array(total), pa.array(s, mask=none), pa.array(x[2][p.to_numpy()] * y[2][q.to_numpy()] < 0)]
                    if with_told:
                        one, two = x[1].take(p), y[1].take(q)
                        out += [turned(one, two), turned(two, one)]
                    yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in kinds.split(", ")])

    found = cells.mapInArrow(run, kinds)
    more = ["told_a", "told_b"] if with_told else []
    return found.select("a", "b", F.round("total", 8).alias("score"), F.col("sim").alias("similarity"), F.array().cast("array<string>").alias("shared_facets"), F.lit(True).alias("same_source"), F.col("conflict").alias("modality_conflict"), *more)


def _linear_pairs(facets: DataFrame, swept: DataFrame, chosen: DataFrame, neighbours: int) -> DataFrame:
    """a, b, shared_facets, same_source of the pairs from identifiers and neighbours: as many as records, near enough."""
    pairs = facet_pairs(facets, swept).unionByName(knn_pairs(chosen, neighbours).withColumn("shared_facets", F.lit(None).cast("array<string>")))
    one = pairs.groupBy("a", "b").agg(F.coalesce(F.max("shared_facets"), F.array().cast("array<string>")).alias("shared_facets"))
    return _same_source(one, swept)


def _same_source(pairs: DataFrame, swept: DataFrame) -> DataFrame:
    """pairs with same_source: both from one non-empty source file."""
    s = swept.select("full_id", F.nullif("source_file", F.lit("")).alias("_s"))
    both = pairs.join(s.select(F.col("full_id").alias("a"), F.col("_s").alias("_sa")), "a").join(s.select(F.col("full_id").alias("b"), F.col("_s").alias("_sb")), "b")
    return both.withColumn("same_source", F.coalesce(F.col("_sa") == F.col("_sb"), F.lit(False))).drop("_sa", "_sb")


def _may_reach(rows: DataFrame, near: DataFrame, least: float) -> DataFrame:
    """Those of rows (full_id, density) that some pair of one source can bring to the score `least`; before any is dealt over blocks.

    A pair with a statement without a vector has SOURCE_BOOST; another one at most that and twice the statement's similarity to its
    nearest, less its density and the lowest one of all.
    """
    if least == -np.inf:
        return rows
    lowest = rows.agg(F.least(F.min("density"), F.lit(0.0)).alias("d")).first().d or 0.0
    top = near.filter("rank = 1").select(F.col("a").alias("full_id"), F.col("sim").alias("_top"))
    bound = F.greatest(F.lit(0.0), F.coalesce(2 * F.col("_top") - F.coalesce("density", F.lit(0.0)) - lowest, F.lit(0.0))) + C.SOURCE_BOOST
    return rows.join(top, "full_id", "left").filter(bound >= least - 1e-6).drop("_top")


def _best_of_sources(swept: DataFrame, vectors: DataFrame, near: DataFrame, judged: DataFrame, least: float, limit: int) -> DataFrame:
    """a, b: of each two blocks of a source, the first `limit` unjudged pairs that may score `least`, by the score that sources and vectors give.

    Statements of a source are dealt over blocks of about PART; a pair of blocks is one matrix product, and no pair leaves it but the first.
    """
    sized = swept.filter("source_file is not null and source_file <> ''").select("full_id", "source_file", T.modality_sign(F.col("modality")).alias("sign"))
    rows = stored(_may_reach(sized.join(density(near), "full_id", "left"), near, least), "audit-may")
    parts = rows.groupBy("source_file").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).filter("parts > 0")
    rows = rows.join(parts, "source_file").join(vectors.select("full_id", "vector"), "full_id", "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("full_id"), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    cell = lambda: F.struct(F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"))
    dealt = rows.withColumn("o", F.explode(others)).withColumn("cell", cell())
    side = dealt.select("source_file", "cell", "full_id", F.lit(None).cast("string").alias("other"), "vector", "density", "sign", "part")
    at = rows.select("full_id", "source_file", "part")
    j = judged.join(at.select(F.col("full_id").alias("a"), "source_file", "part"), "a").join(at.select(F.col("full_id").alias("b"), F.col("source_file").alias("_s"), F.col("part").alias("o")), "b").filter("source_file = _s")
    done = j.withColumn("cell", cell()).select("source_file", "cell", F.col("a").alias("full_id"), F.col("b").alias("other"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("double").alias("density"), F.lit(None).cast("int").alias("sign"), F.lit(None).cast("int").alias("part"))

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        own = sorted((r for r in rows if r["other"] is None), key=lambda r: r["full_id"])
        ids = [r["full_id"] for r in own]
        number = {x: n for n, x in enumerate(ids)}
        cell = rows[0]["cell"]
        left = np.array([n for n, r in enumerate(own) if r["part"] == cell["i"]], dtype=np.int64)
        right = np.array([n for n, r in enumerate(own) if r["part"] == cell["j"]], dtype=np.int64)
        widths = np.array([len(r["vector"]) if r["vector"] is not None else -1 for r in own])
        rho = np.array([r["density"] or 0.0 for r in own])
        sign = np.array([r["sign"] or 0 for r in own])
        score = np.full((len(left), len(right)), C.SOURCE_BOOST)
        for w in set(widths.tolist()) - {-1}:
            v = np.zeros((len(own), max(w, 1)))
            for n in np.flatnonzero(widths == w):
                v[n, :w] = own[n]["vector"]
            size = np.sqrt((v * v).sum(1))
            v /= np.where(size > 0, size, 1)[:, None]
            p, q = np.flatnonzero(widths[left] == w), np.flatnonzero(widths[right] == w)
            score[np.ix_(p, q)] += 2 * (v[left[p]] @ v[right[q]].T)
        with_ = widths >= 0
        score -= np.where(with_[left][:, None] & with_[right][None, :], rho[left][:, None] + rho[right][None, :], 0)
        if cell["i"] == cell["j"]:
            score[left[:, None] >= right[None, :]] = -np.inf
        place_l, place_r = {n: k for k, n in enumerate(left.tolist())}, {n: k for k, n in enumerate(right.tolist())}
        for r in rows:
            if r["other"] is not None:
                for x, y in ((number[r["full_id"]], number[r["other"]]), (number[r["other"]], number[r["full_id"]])):
                    if x in place_l and y in place_r:
                        score[place_l[x], place_r[y]] = -np.inf
        p, q = np.nonzero(np.isfinite(score) & (score >= least - 1e-6))
        a, b, value = left[p], right[q], np.round(score[p, q], 8)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        # the queue's order: score, opposed modalities first, ids, whose order is that of the numbers
        order = np.lexsort((hi, lo, sign[lo] * sign[hi] >= 0, -value))
        if len(order) > limit:  # what may be the same score but for rounding stays, the first of each value
            value = value[order]
            rank = np.arange(len(order)) - np.searchsorted(-value, -value, "left")
            order = order[(value >= value[limit - 1] - 1e-7) & (rank < limit)]
        return pa.table({"a": pa.array([ids[n] for n in lo[order]], pa.string()), "b": pa.array([ids[n] for n in hi[order]], pa.string())})

    return side.unionByName(done).groupBy("source_file", "cell").applyInArrow(run, "a string, b string").distinct()


def first_page(statements: DataFrame, facets: DataFrame, embeddings: DataFrame, edges: DataFrame, verdicts: DataFrame, model: str, namespace: str | None = None, neighbours: int = C.AUDIT_NEIGHBOURS, floor: float = 0.0, limit: int = C.AUDIT_LIMIT) -> DataFrame:
    """The first `limit` rows of audit()'s queue in its order, without a row for every pair of a source.

    The lists of identifiers and neighbours, which grow with the records, are scored whole; their limit-th score is what a pair
    of one source must reach to matter, and such pairs are sought block by block. What both give is scored as the queue is.
    """
    swept = scope(statements, namespace).select("full_id", "namespace", "status", "modality", "source_file")
    vectors = stored(swept_vectors(embeddings, swept, model), "audit-vectors")
    near = stored(V.nearest(vectors, max(neighbours, C.DENSITY_K)), "audit-near")
    chosen = V.nearest(vectors, neighbours, floor) if floor > 0 else near
    judged = stored(adjudicated(edges, verdicts), "audit-judged")
    lists = stored(_linear_pairs(facets, swept, chosen, neighbours).join(judged, ["a", "b"], "left_anti"), "audit-lists")
    first = stored(page(score(lists, swept, vectors, near), limit), "audit-first")
    last = first.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    least = last.least if last.n >= limit else -np.inf
    more = _best_of_sources(swept, vectors, near, judged, float(least), limit).join(lists, ["a", "b"], "left_anti")
    more = more.select("a", "b", F.array().cast("array<string>").alias("shared_facets"), F.lit(True).alias("same_source"))
    return page(first.unionByName(score(more, swept, vectors, near).select(*first.columns)), limit)


def progress(statements: DataFrame, facets: DataFrame, embeddings: DataFrame, edges: DataFrame, verdicts: DataFrame, model: str, namespace: str | None = None, neighbours: int = C.AUDIT_NEIGHBOURS, floor: float = 0.0) -> DataFrame:
    """remaining, swept, statements, depth as audit() says them, by counting: a source of n statements has n (n - 1) / 2 pairs, n - 1 of each.

    To these come the pairs of the other lists that are of no one source; off go the judged ones of either.
    """
    swept = scope(statements, namespace).select("full_id", "namespace", "status", "modality", "source_file")
    vectors = swept_vectors(embeddings, swept, model)
    near = V.nearest(vectors, neighbours, floor)
    lists = stored(_linear_pairs(facets, swept, near, neighbours), "audit-lists")
    judged = _same_source(adjudicated(edges, verdicts).filter("a <> b"), swept)
    own = judged.filter("same_source").select("a", "b", F.lit(-1).alias("n"))
    rest = lists.filter("not same_source").select("a", "b").join(judged.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", F.lit(1).alias("n"))
    pairs = own.unionByName(rest)
    of_source = swept.filter("source_file is not null and source_file <> ''").groupBy("source_file").agg((F.count(F.lit(1)) - 1).alias("n"))
    degree = swept.select("full_id", "source_file").join(of_source, "source_file").select("full_id", "n").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("full_id"), F.col("n").cast("long").alias("n")))
    busy = degree.groupBy("full_id").agg(F.sum("n").alias("n")).agg(F.count_if(F.col("n") > 0).alias("busy"), F.expr("coalesce(sum(n), 0) div 2").alias("remaining"))
    every = swept.agg(F.count(F.lit(1)).alias("statements"))
    return busy.crossJoin(F.broadcast(every)).select("remaining", (F.col("statements") - F.col("busy")).alias("swept"), "statements", F.lit(neighbours).alias("depth"))  # one row each


def page(queue: DataFrame, limit: int = C.AUDIT_LIMIT) -> DataFrame:
    out = queue.orderBy(F.desc("score"), F.desc("modality_conflict"), "a", "b")
    return out.limit(limit) if limit else out


def ordered_by_scores(queue: DataFrame, scores: DataFrame, bodies: DataFrame, identity: str, limit: int = C.AUDIT_LIMIT) -> DataFrame:
    """The queue by contradiction, then by its own order; the whole queue is scored before the page is cut. Unscored pairs come last."""
    h = bodies.select("full_id", F.sha2("body", 256).alias("_h"))
    cache = scores.filter(F.col("identity") == identity).select(F.col("a_hash").alias("_ha"), F.col("b_hash").alias("_hb"), F.col("score").alias("contradiction"))
    q = queue.join(h.select(F.col("full_id").alias("a"), F.col("_h").alias("_ha")), "a").join(h.select(F.col("full_id").alias("b"), F.col("_h").alias("_hb")), "b")
    return by_contradiction(q.join(cache, ["_ha", "_hb"], "left").drop("_ha", "_hb"), limit)


def by_contradiction(queue: DataFrame, limit: int = C.AUDIT_LIMIT) -> DataFrame:
    """A queue whose pairs are scored where they are made (contradiction), in the order of ordered_by_scores."""
    out = queue.orderBy(F.desc_nulls_last("contradiction"), F.desc("score"), F.desc("modality_conflict"), "a", "b")
    return out.limit(limit) if limit else out


def with_bodies(pairs: DataFrame, statements: DataFrame, limit: int = C.AUDIT_LIMIT) -> DataFrame:
    """The page with both bodies and excerpts, for writing as JSON lines; a page of `limit` rows is sent to the bodies, an unlimited one (0) is joined."""
    b = statements.select("full_id", "body")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("full_id")).distinct()
    ids = F.broadcast(ids) if limit else ids
    own = b.join(ids, "full_id", "left_semi")
    named = lambda x: own.select(F.col("full_id").alias(x), F.col("body").alias(f"body_{x}"), T.excerpt(F.col("body")).alias(f"excerpt_{x}"))
    return pairs.join(named("a"), "a").join(named("b"), "b")
