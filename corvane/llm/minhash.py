"""Near duplicates by one-permutation MinHash with optimal densification.

One hash of each shingle decides both its bin and its rank in it; a bin's value is
its least hash. Empty bins borrow from a bin that a universal hash of (bin, try)
picks, the same for every document (Shrivastava, 2017). ROWS bins make a band;
there are as many bands as leave a pair at the threshold unseen once in a million.
That holds for sets that fill their bins. Smaller ones borrow, and their bands agree
or differ together: sets under TWICE shingles have bands of a second permutation,
and pairs with a set under SMALL are found exactly. Two such sets of given sizes
differ in at most d shingles, so of d + r parts into which a hash deals all
shingles, r at least are the same in both; the contents of any r parts are a key,
r chosen so that a key holds most of a set. Sizes go in classes that each reach to
the largest partner of their smallest, and a set has keys of its own class and of
the one below.

Documents with equal sets are one class from the start, so copies make no pairs; a
class is known by a 64-bit hash of its set.
A bucket's candidate edges form a star: every member is compared with its centre
only, the member that meets most others over all bands. Edges, were it of one band
only, are confirmed on full shingle sets (of 64-bit hashes, so that a link could be
wrong only where two shingles share one). A star can miss a link between two
members that are both unlike the centre, so what still holds several components is
gone through once more, in blocks inside tasks: members outside a bucket's largest
component are compared on full sets with members of all others. A task joins two
components over a confirmed link only, and only links that span leave it, so rows
stay in proportion to the documents and nothing is capped. Sets too small to have a
partner (|s| / (|s| + 1) under the threshold) are compared for equality only.

Defined cases: null or wordless text has an empty set, links with nothing and is
kept; rows that share a doc_id are one document, with all links of their texts, and
come out once each; rows with a null id come out with null component and kept true;
an empty table gives an empty one; other columns are ignored (report) or kept
(keep_first).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import components
from corvane.llm.scratch import cut, let_go

ROWS, MISS = 5, 1e-6
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
SMALL, TWICE, KEYS, LONG_ROWS = 100, 512, 21, 8
BITS = 1 << 26  # of the map that tells which texts are wanted, 8 MB whatever the input


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words; linked from `percent` of a hundred on."""

    words: int = 5
    percent: int = 80

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def bins(self) -> int:
        return self.bands * ROWS

    @property
    def least(self) -> int:
        """The smallest set that a different set can be like enough."""
        return math.ceil(self.percent / (100 - self.percent)) if self.percent < 100 else 1 << 30


@cache
def size_classes(percent: int) -> list[tuple[int, int, int, tuple[tuple[int, ...], ...]]]:
    """(least size, largest size, parts, combinations of parts) of the classes whose smaller sets are under SMALL; none where a pair cannot differ."""
    out, low = [], 1
    while low < SMALL:
        high = low * 100 // percent
        differ = max(n + m - 2 * -(-percent * (n + m) // (100 + percent)) for n in range(low, high + 1) for m in range(n, n * 100 // percent + 1))
        r = 1  # the most parts that leave no more than KEYS combinations
        while differ and math.comb(differ + r + 1, r + 1) <= KEYS and r < 5:
            r += 1
        out.append((low, high, differ + r, tuple(combinations(range(differ + r), r)) if differ else ()))
        low = high + 1
    return out


def exact_keys(u: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set, one of which it shares with each set that is like enough, where the smaller of the two is under SMALL."""
    keys = []
    for k, (low, high, parts, some) in enumerate(size_classes(percent)):
        if low <= len(u) and len(u) * percent <= 100 * high and some:
            mixed = _mix(u ^ np.uint64(0xA0761D6478BD642F * (k + 1) & (2**64 - 1)))
            part, held = mixed % np.uint64(parts), np.zeros(parts, dtype=np.uint64)
            np.add.at(held, part.astype(np.int64), _mix(mixed))
            of = held[np.array(some)].sum(1, dtype=np.uint64)
            keys.append(_mix(of ^ _mix(np.arange(len(some), dtype=np.uint64) + np.uint64((k + 1) << 32))))
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, rule: Rule) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles. bytes.lower() and bytes.split() know A-Z and the six ASCII blanks only."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(rule.words, len(w))
    h = np.full(len(w) - k + 1, 0x9E3779B97F4A7C15 * k & (2**64 - 1), dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD1342543DE82EF95) + w[i : len(w) - k + 1 + i]
    return np.unique(_mix(h))


def donors(bins: int) -> Iterator[np.ndarray]:
    """For each try, the bin that each empty bin asks."""
    at, k = np.arange(bins, dtype=np.uint64), 0
    while True:
        k += 1
        yield (_mix(at * np.uint64(0x2545F4914F6CDD1D) + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(bins)).astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of bins per set; sets are not empty. Sorted hashes fall into bins in order, so a bin's least is its first."""
    out = np.zeros((len(sets), bins), dtype=np.uint64)
    full = np.zeros((len(sets), bins), dtype=bool)
    for i, u in enumerate(sets):
        b = ((u >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(b, prepend=-1))
        out[i, b[first]] = u[first]
        full[i, b[first]] = True
    rows = np.flatnonzero(~full.all(axis=1))
    had, filled, values = full[rows], full[rows].copy(), out[rows]
    for ask in donors(bins):
        if not len(rows):
            break
        take = ~filled & had[:, ask]
        i, j = np.nonzero(take)
        values[i, j] = values[i, ask[j]]
        filled |= take
        done = filled.all(axis=1)
        if done.any():
            out[rows[done]] = values[done]
            rows, had, filled, values = rows[~done], had[~done], filled[~done], values[~done]
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, bands = len(sig), sig.shape[1] // rows
    grid = sig[:, : bands * rows].reshape(n, bands, rows)
    h = np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(1)
    for i in range(rows):
        h = _mix(h * np.uint64(0xD1342543DE82EF95) + grid[:, :, i])
    return h.view(np.int64)


def keys_of(sets: list[np.ndarray], rule: Rule) -> list[np.ndarray]:
    """The keys of each set: bands of its bins, longer ones of a second permutation where it is under TWICE, exact ones where a smaller partner can be under SMALL."""
    out = [[exact_keys(u, rule.percent).view(np.int64)] for u in sets]
    for again, most in ((0, 1 << 62), (1, TWICE)):
        own = [i for i, u in enumerate(sets) if SMALL <= len(u) < most]
        if own:
            salt = np.uint64(0x8BB84B93962EACC9)
            sig = signatures([np.sort(_mix(sets[i] ^ salt)) if again else sets[i] for i in own], rule.bins)
            for i, k in zip(own, band_keys(sig, LONG_ROWS if again else ROWS)):
                out[i].append(k ^ np.int64(again))
    return [np.concatenate(x) for x in out]


def sketch(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, set_key, bands of every row; bands are null where no other set can be like enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sets = [shingles(x.as_py(), rule) for x in b.column("text")]
                keys = [xxhash.xxh3_128_digest(u.tobytes()) if len(u) else None for u in sets]
                big = [i for i, u in enumerate(sets) if len(u) >= rule.least]
                bands: list = [None] * len(sets)
                for i, k in zip(big, keys_of([sets[i] for i in big], rule)):
                    bands[i] = k
                cols = [b.column("doc_id"), pa.array([len(u) for u in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def _bit(doc_id):
    return F.pmod(F.xxhash64(doc_id), F.lit(BITS))


def bit_map(ids: DataFrame):
    """A broadcast map of BITS bits, those set that the hashes of column rep name; built in parts of 4 KB, 2,048 at most."""
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    at = ids.select((_bit(F.col("rep")) + 1).alias("b"))  # bitmaps count from 1
    for r in at.groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect():
        part = np.frombuffer(r.m, dtype=np.uint8)
        begin = (r.n - 1) * len(part)
        bits[begin : begin + len(part)] |= part[: len(bits) - begin]
    return ids.sparkSession.sparkContext.broadcast(bits)


def shingle_sets(docs: DataFrame, ids: DataFrame, rule: Rule) -> DataFrame:
    """id (of the class), set, brief (the set's shingles in 16 bits each) of the documents whose doc_id is a rep of ids, and of a few more.

    A map of bits picks the texts where they are read, so no text is shuffled; the sets are joined to what is wanted afterwards.
    """
    wanted = bit_map(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                bit = b.column("b").to_numpy(zero_copy_only=False)
                some = np.flatnonzero(wanted.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                sets = [shingles(b.column("text")[int(i)].as_py(), rule) for i in some]
                sets = [u for u in sets if len(u)]
                keys = [xxhash.xxh3_128_digest(u.tobytes()) for u in sets]
                brief = [brief_set(u).tobytes() for u in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([u.view(np.int64) for u in sets], pa.list_(pa.int64())), pa.array(brief, pa.binary())], ["set_key", "set", "brief"])

    rows = docs.filter("doc_id is not null").select(_bit(F.col("doc_id").cast("bigint")).alias("b"), "text")
    return rows.mapInArrow(run, "set_key binary, set array<bigint>, brief binary").select(_class(), "set", "brief")


def brief_set(u: np.ndarray) -> np.ndarray:
    """16 bits of each shingle, sorted. Two sets share no more shingles than one has whose bits the other knows."""
    return np.sort((u >> np.uint64(17)).astype("<u2"))


def maybe_alike(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose brief sets leave room for a link: all that are linked, and next to nothing else."""
    briefs = lambda name, x: sets.select(F.col("id").alias(name), F.col("brief").alias(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("_s"), b.column("_t")):
                u, v = (np.frombuffer(z.as_buffer(), dtype="<u2") for z in (x, y))
                small, large = (u, v) if len(u) <= len(v) else (v, u)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                ok.append(100 * both >= rule.percent * (len(u) + len(v) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.select("a", "b").join(briefs("b", "_t"), "b").join(briefs("a", "_s"), "a").select("a", "b", "_s", "_t")
    return both.mapInArrow(run, "a bigint, b bigint")


def _class():
    """The number of a class: a hash of its set's key."""
    return F.xxhash64("set_key").alias("id")


def confirmed(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose full sets are like enough. Both joins meet a side with one row per id, so a hot id can be split."""
    centres = sets.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    s, t = centres.select(F.col("id").alias("a"), F.col("set").alias("_s")), sets.select(F.col("id").alias("b"), F.col("set").alias("_t"))
    both = pairs.select("a", "b").join(t, "b").join(s, "a").select("a", "b", F.size(F.array_intersect("_s", "_t")).cast("long").alias("_i"), (F.size("_s") + F.size("_t")).cast("long").alias("_n"))
    return both.filter(100 * F.col("_i") >= rule.percent * (F.col("_n") - F.col("_i"))).select("a", "b")


def _like(table: pa.Table, rule: Rule):
    """x -> which rows of table have a set like the set x."""
    column = table.column("value").combine_chunks()
    values, ends = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy()).cumsum()
    size = np.diff(ends, prepend=0)
    known, numbers = np.unique(values, return_inverse=True)
    mark = np.zeros(len(known), dtype=np.int64)
    begin = ends - size

    def like(x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, x)
        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == x)]
        mark[at] = 1
        both = np.add.reduceat(mark[numbers], begin)  # no set is empty here
        mark[at] = 0
        return 100 * both >= rule.percent * (size + len(x) - both)

    return like


def _forest(rule: Rule):
    """For one block: links (a, b) of left rows to right rows, confirmed on their sets, that span what they join across components."""

    def run(table: pa.Table) -> pa.Table:
        left = table.filter(pa.compute.equal(table.column("side"), 0))
        right = table.filter(pa.compute.equal(table.column("side"), 1))
        a, b = [], []
        if left.num_rows and right.num_rows:
            ids, own = right.column("id").to_numpy(), left.column("id").to_numpy()
            # members of a component bear one label from the start; a link makes two labels one
            _, label = np.unique(np.concatenate([left.column("comp").to_numpy(), right.column("comp").to_numpy()]), return_inverse=True)
            mine, theirs = label[: len(own)], label[len(own) :]
            like = _like(right, rule)
            for k in range(len(own)):
                if (theirs == mine[k]).all():
                    continue
                found = np.flatnonzero(like(left.column("value")[k].values.to_numpy()) & (theirs != mine[k]))
                others, first = np.unique(theirs[found], return_index=True)
                for old, y in zip(others, ids[found[first]].tolist()):
                    a.append(min(int(own[k]), y))
                    b.append(max(int(own[k]), y))
                    label[label == old] = mine[k]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _blocks(rows: DataFrame, rule: Rule) -> DataFrame:
    """Links from rows (key, id, comp, value, outside, lefts, rights) compared in blocks: outsiders of a key, in lefts parts, with all of it, in rights parts."""
    part = lambda n: F.pmod(F.hash("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["key", "id", "comp", "value"]
    left = rows.filter("outside").select(*cols, part("lefts").alias("i"), every("rights").alias("j"), F.lit(0).alias("side"))
    right = rows.select(*cols, every("lefts").alias("i"), part("rights").alias("j"), F.lit(1).alias("side"))
    return left.unionByName(right).groupBy("key", "i", "j").applyInArrow(_forest(rule), "a bigint, b bigint").distinct()


def _named(ids: DataFrame, comps: DataFrame) -> DataFrame:
    """ids (with a column id) with comp: the component, or the id itself."""
    return ids.join(comps, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")


def linked(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(sketches of all rows, doc -> component of all documents that have a class mate or a link: id, root)."""
    sig = cut(sketch(docs, rule), "sketch")
    known = sig.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("_last"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")).withColumn("id", _class()), "classes")
    # texts of one doc_id are linked as they stand
    own = known.select("doc_id", _class())
    several = own.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("_b")).filter("a < _b").select("doc_id", "a")
    same = cut(own.join(several, "doc_id").filter("id <> a").select("a", F.col("id").alias("b")).distinct(), "same")
    heads = classes.filter("bands is not null").select("id", "bands", "n")
    rows = heads.select("id", F.explode("bands").alias("key")).distinct()
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = cut(rows.join(sizes, "key").select("key", "id", "size"), "members")
    meets = members.groupBy("id").agg(F.sum("size").alias("meets"))
    members = members.drop("size").join(meets, "id").join(heads.select("id", "n"), "id")
    rank = F.struct(F.col("meets"), -F.col("id"))
    centres = members.groupBy("key").agg(F.max_by(F.struct(F.col("id").alias("a"), F.col("n").alias("m")), rank).alias("c")).select("key", "c.a", "c.m")
    fit = 100 * F.least("n", "m") >= rule.percent * F.greatest("n", "m")  # sets of other sizes cannot be alike
    stars = cut(members.join(centres, "key").filter("id <> a").filter(fit).select("a", F.col("id").alias("b")).distinct(), "stars")
    involved = cut(classes.select("id", "rep").join(meets.select("id"), "id", "left_semi"), "involved")
    found = shingle_sets(docs, involved.select("rep").distinct(), rule)
    sets = cut(found.join(involved.select("id"), "id", "left_semi").dropDuplicates(["id"]), "sets")
    let_go(docs.sparkSession)
    links = cut(confirmed(cut(maybe_alike(stars, sets, rule), "maybe"), sets, rule).unionByName(same), "links")
    comps = cut(components(links), "comps")
    # what still holds several components: buckets by full sets, all outsiders of the largest component with all others
    at = cut(_named(members.select("key", "id"), comps).join(heads.select("id", "n"), "id"), "at")
    size, n = F.sum("size"), F.sum("n")
    most = F.struct(F.col("size"), -F.col("comp"))
    parts = lambda size, n: F.greatest(F.ceil(size / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    # buckets of the same members are gone through once: like documents share several keys
    names = lambda of: [F.bit_xor(c).alias(x) for c, x in zip(of, ("_x", "_y"))]
    mixed = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"), n.alias("n"), *names((F.xxhash64("id"), F.xxhash64(F.lit(1), "id")))).groupBy("key").agg(F.count(F.lit(1)).alias("comps"), size.alias("size"), F.max_by("comp", most).alias("main"), parts(size - F.max("size"), n - F.max_by("n", most)).alias("lefts"), parts(size, n).alias("rights"), *names((F.col("_x"), F.col("_y"))))
    mixed = mixed.filter("comps > 1 and size > 2").groupBy("_x", "_y", "size").agg(*[F.min_by(c, "key").alias(c) for c in ("main", "lefts", "rights")], F.min("key").alias("key")).drop("_x", "_y", "size")
    rest = at.drop("n").join(mixed, "key").join(sets, "id").select("key", "id", "comp", F.col("set").alias("value"), (F.col("comp") != F.col("main")).alias("outside"), "lefts", "rights")
    more = cut(_blocks(rest, rule), "more")
    roots = comps if more.isEmpty() else cut(components(links.unionByName(more)), "comps")
    # components by their least doc_id, then all documents of classes that have copies or links
    named = classes.select("set_key", "id", "rep", "_last").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = cut(named.filter("rep < _last").unionByName(named.filter("rep = _last").join(roots.select("id"), "id", "left_semi")).select("set_key", "root", "rep", "_last"), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    named = named.join(least, "root")
    copies = named.filter("rep < _last").select("set_key", "least").join(sig.select("set_key", F.col("doc_id").alias("id")).filter("id is not null"), "set_key")
    alone = named.filter("rep = _last").select(F.col("rep").alias("id"), "least")
    return sig, copies.select("id", "least").unionByName(alone).groupBy("id").agg(F.min("least").alias("root"))


def report(docs: DataFrame, rule: Rule = Rule(3, 85)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    sig, roots = linked(docs.select("doc_id", "text"), rule)
    joined = sig.join(roots, sig["doc_id"] == roots["id"], "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    return joined.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of docs but those whose component has a smaller doc_id; all rows of the smallest stay."""
    _, roots = linked(docs.select("doc_id", "text"), rule)
    gone = roots.filter("id <> root").select("id")
    return docs.join(gone, docs["doc_id"] == gone["id"], "left_anti")


#: The same by brute force: every pair that shares a shingle, and what can be reached from each document.
LINKS_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
sets AS (SELECT list_sort(g) AS g, len(g) AS n, min(doc_id) AS rep FROM g WHERE len(g) > 0 GROUP BY ALL),
s AS (SELECT rep, n, unnest(g) AS h FROM sets),
pairs AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_ FROM s a JOIN s b ON a.h = b.h AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * both_ >= 85 * (na + nb - both_)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, root) AS (SELECT a, a FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY 1)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, coalesce(roots.root, sets.rep, g.doc_id) AS component_id, g.doc_id = coalesce(roots.root, sets.rep, g.doc_id) AS kept
FROM g LEFT JOIN sets ON list_sort(g.g) = sets.g LEFT JOIN roots ON roots.id = sets.rep
"""
