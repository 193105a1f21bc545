"""Alignment of two tokenizers' tokens, and how often ids are linked.

A text's tokens by A and by B are the two sides of a graph; tokens whose byte ranges
overlap are joined. Between two neighbouring ends of either side lies exactly one
overlap, so the edges come from one merge of the ends. Union-find (least label by
hooking and pointer jumping, over a batch of texts at once) gives the connected
components, which are the minimal groups: A and B tokens cover the same bytes and
both end there. Members of a component are linked, each A token with each B token.

Distinct id pairs of a text, with their occurrences, are written once. Pairs are
counted over documents with a partial count in every task. The counts come back in
two tiers, since one row per pair and text would move more than the texts: at most
TABLE pairs of the highest counts are broadcast (a bound whatever the input) and
looked up where the text's pairs are; the others are joined by shuffle. A highest
count per A id is one row per id of a vocabulary. A text whose pairs are more than
PART is written in several rows, at most PART pairs (and one A id's) each.

Defined cases: texts that are null, empty, or that a side does not give back byte by
byte have no tokens: zeros and ''. Special strings in texts are plain text. Rows that
share a doc_id are one document in the counts and rows of their own in the result;
rows with a null doc_id are a document each; repeated rows come out each; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import vocab
from corvane.llm.scratch import cut

TABLE, PART = 1 << 18, 1 << 21
BATCH_BYTES = 1 << 20

class Sides:
    """Both tokenizers: text -> ids and token lengths in bytes, or None where a side does not give the text back."""

    def __init__(self, a: tuple[bytes, bool], b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = vocab.Encoder(*a)
        self.a.tok = Tokenizer.from_str(a[0].decode())  # its own, as special strings are plain text here only
        self.a.tok.encode_special_tokens = True
        self.a.marks = []
        bare = {chr(c): i for i, c in vocab.byte_characters().items()}
        names = [self.a.tok.id_to_token(i) or "" for i in range(self.a.tok.get_vocab_size())]
        self.bytes_a = [bytes(bare[c] for c in x) if all(c in bare for c in x) else x.encode() for x in names]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_b = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.size_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.width = len(self.bytes_b)
        self.most = max(len(self.bytes_a), self.width)
        self.names = np.array([f"{i}{sep}" for sep in ",|;" for i in range(self.most)], dtype="S")

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        if not text:
            return None
        whole = (" " + text).encode()
        b = self.b.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        a = self.a(" " + text)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != whole:
            return None
        return a.astype(np.int64), np.array(b, dtype=np.int64)


def union(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component; edges join x to y."""
    root = np.arange(n)
    while True:
        a, b = root[x], root[y]
        open_ = a != b
        if not open_.any():
            return root
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group number, from 0 in order, of each A and each B token, from the ascending ends of both over the same bytes."""
    n = len(ends_a)
    both = np.concatenate([ends_a, ends_b])
    order = np.argsort(both, kind="stable")  # two sorted runs, merged; at equal ends A's comes first
    last = np.flatnonzero(np.diff(both[order], append=-1))  # of each distinct end
    of_a = order < n
    upto = of_a.cumsum()[last]
    # the tokens whose last byte lies before each end: as many ends lie before it
    x = upto - np.where(of_a[last], 1, of_a[last - 1] & (both[order[last - 1]] == both[order[last]]))
    y = (last + 1 - upto) - ~of_a[last]
    label = union(len(both), x, y + n)
    number = (label[:n] == np.arange(n)).cumsum() - 1  # a component's least member is an A token, and those ascend
    return number[label[:n]], number[label[n:]]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.zeros(len(keys[0]), dtype=bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each is found."""
    key = np.sort(key)
    first = _runs(key)
    return key[first], np.diff(first, append=len(key))


def expanded(text: np.ndarray, ga: np.ndarray, a: np.ndarray, gb: np.ndarray, b: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, pair, times): distinct links of each text, members of equal group linked, at most about PART at a time and no A id of a text parted.

    text is the text of each group; pair is A id * width + B id.
    """
    span = int(max(a.max(initial=0) + 1, width))
    ka, na = _distinct(ga * span + a)
    kb, nb = _distinct(gb * span + b)
    ga, a, gb, b = ka // span, ka % span, kb // span, kb % span
    order = np.argsort(text[ga] * span + a, kind="stable")
    ga, a, na = ga[order], a[order], na[order]
    held = np.bincount(gb, minlength=len(text))
    low, size = (held.cumsum() - held)[ga], held[ga]
    ends, first = size.cumsum(), _runs(text[ga], a)
    at = 0
    while at < len(ga):
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right"))
        to = len(ga)
        if full < len(ga):  # back to where an A id of a text begins, or on to where the next one does
            k = int(np.searchsorted(first, full, "right")) - 1
            to = int(first[k]) if first[k] > at else int(first[k + 1]) if k + 1 < len(first) else len(ga)
        n = size[at:to]
        left = np.repeat(np.arange(at, to), n)
        right = np.arange(len(left)) - np.repeat(n.cumsum() - n - low[at:to], n)
        t, pair, times = text[ga[left]], a[left] * width + b[right], na[left] * nb[right]
        order = np.argsort(t * (span * width) + pair)
        t, pair, times = t[order], pair[order], times[order]
        new = _runs(t, pair)
        yield t[new], pair[new], np.add.reduceat(times, new)
        at = to


ALIGNED = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def _align(ids: list, sides: Sides) -> tuple[list[tuple], Iterator]:
    """(n_a, n_b, n_groups, n_links, groups_sha256) of each text's ids (None: no tokens), and their links."""
    some = [i for i, x in enumerate(ids) if x is not None]
    facts: list[tuple] = [(0, 0, 0, 0, "")] * len(ids)
    if not some:
        return facts, iter(())
    a, b = np.concatenate([ids[i][0] for i in some]), np.concatenate([ids[i][1] for i in some])
    ga, gb = groups(sides.size_a[a].cumsum(), sides.size_b[b].cumsum())
    many = int(ga[-1]) + 1
    na, nb = np.bincount(ga, minlength=many), np.bincount(gb, minlength=many)
    # a group's text: that of its first A token
    of_a = np.repeat(some, [len(ids[i][0]) for i in some])
    begin_a = na.cumsum() - na
    text = of_a[begin_a]
    # A tokens of a group, then its B tokens, each with the sign that follows
    order = np.argsort(np.concatenate([2 * ga, 2 * gb + 1]), kind="stable")
    sign = np.zeros(len(order), dtype=np.int64)
    after = (na + nb).cumsum()
    sign[after - nb - 1], sign[after - 1] = 1, 2
    names = sides.names[np.concatenate([a, b])[order] + sign * sides.most]
    links, at = na * nb, 0
    ends = np.searchsorted(text, some, "right")
    for i, lo, hi in zip(some, np.searchsorted(text, some, "left").tolist(), ends.tolist()):
        n = len(ids[i][0]) + len(ids[i][1])
        said = names[at : at + n].tobytes().translate(None, b"\0")[:-1]
        at += n
        facts[i] = (len(ids[i][0]), len(ids[i][1]), hi - lo, int(links[lo:hi].sum()), hashlib.sha256(said).hexdigest())
    return facts, expanded(text, ga, a, gb, b, sides.width)


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> tuple[DataFrame, int]:
    """(ALIGNED: a row per text, and further rows of nulls but for pairs where it has many; the width of B's vocabulary)."""
    import sentencepiece

    spark = docs.sparkSession
    a = vocab.ship(spark, path_a or vocab.default_path("byte_bpe_50k.json"))
    with open(path_b or vocab.default_path("piece_bpe_32k.model"), "rb") as f:
        content = f.read()
    b = spark.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = vocab.once("sides", (hash(a.value[0]), hash(b.value)), lambda: Sides(a.value, b.value))

        def out(rows, docs_, texts):
            facts, found = _align([sides(x) for x in texts], sides)
            row, pairs, times = [], [], []
            for t, pair, n in found:
                first = _runs(t)
                row += t[first].tolist()
                pairs += np.split(pair, first[1:])
                times += np.split(n, first[1:])
            rest = sorted(set(range(len(texts))) - set(row))
            row, pairs, times = row + rest, pairs + [none] * len(rest), times + [none] * len(rest)
            head = np.zeros(len(row), dtype=bool)
            head[np.unique(row, return_index=True)[1]] = True
            said = [facts[i] if h else (None,) * 5 for i, h in zip(row, head)]
            who = [docs_[i] if h else None for i, h in zip(row, head)]
            cols = [pa.array([rows[i] for i in row], pa.int64()), pa.array(who, pa.int64())]
            cols += [pa.array([x[k] for x in said], pa.int64()) for k in range(4)] + [pa.array([x[4] for x in said], pa.string())]
            cols += [pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in ALIGNED.split(", ")])

        none = np.zeros(0, dtype=np.int64)
        for batch in batches:
            rows, docs_ = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
            held, at = [], 0
            size = 0
            for k, x in enumerate(batch.column("text")):
                text = x.as_py()
                held.append(text)
                size += len(text or "")
                if size >= BATCH_BYTES or k == batch.num_rows - 1:
                    yield out(rows[at : k + 1], docs_[at : k + 1], held)
                    held, at, size = [], k + 1, 0

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ALIGNED), sentencepiece.SentencePieceProcessor(model_proto=content).vocab_size()


def pair_counts(done: DataFrame) -> DataFrame:
    """pair, docs: how many documents hold each pair."""
    ids = done.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    rows = done.select("row", F.explode("pairs").alias("pair"))
    if not (twice := cut(ids, "repeated")).isEmpty():  # rows of one document: its pairs count once
        same = cut(done.filter("doc_id is not null").select("row", "doc_id").join(twice, "doc_id"), "same")
        rows = rows.join(same, "row", "left")
        one = rows.filter("doc_id is not null").select("doc_id", "pair").distinct().select("pair")
        rows = rows.filter("doc_id is null").select("pair").unionByName(one)
    return rows.groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))


def rated(counts: DataFrame, width: int) -> DataFrame:
    """pair, docs, best: whether no pair of its A id is in more documents. The highest counts are a row per id of A."""
    a = F.expr(f"pair div {width}")
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def frequent(spark: SparkSession, rates: DataFrame, most: int):
    """A broadcast of (pair, docs, best), sorted by pair, of all pairs in 2^k documents or more, k the least that leaves at most `most`; and 2^k."""
    sizes = {r.k: r.n for r in rates.groupBy(F.floor(F.log2("docs") + 1e-9).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 64 rows
    k, n = max(sizes, default=0) + 1, 0
    while k > 0 and n + sizes.get(k - 1, 0) <= most:
        k -= 1
        n += sizes.get(k, 0)
    held = rates.filter(F.col("docs") >= 1 << k).toArrow()
    order = np.argsort(held.column("pair").to_numpy())
    table = tuple(held.column(c).to_numpy()[order] for c in ("pair", "docs", "best"))
    return spark.sparkContext.broadcast(table), 1 << k


FACTS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
KNOWN = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"


def looked_up(done: DataFrame, table) -> DataFrame:
    """KNOWN: the facts of each row of done, the sums over links that the broadcast table knows, and the other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs, best = table.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                x, n = b.column("pairs").flatten().to_numpy(), b.column("times").flatten().to_numpy()
                of = np.repeat(np.arange(b.num_rows), np.diff(b.column("pairs").offsets.to_numpy()))
                k = np.minimum(np.searchsorted(pair, x), max(len(pair) - 1, 0))
                hit = pair[k] == x if len(pair) else np.zeros(len(x), dtype=bool)
                sums = [np.zeros(b.num_rows, dtype=np.int64) for _ in range(2)]
                np.add.at(sums[0], of[hit], n[hit] * best[k[hit]])
                np.add.at(sums[1], of[hit], n[hit] * docs[k[hit]])
                ends = pa.array(np.append(0, np.bincount(of[~hit], minlength=b.num_rows).cumsum()).astype(np.int32))
                rest = [pa.ListArray.from_arrays(ends, pa.array(z[~hit])) for z in (x, n)]
                yield pa.RecordBatch.from_arrays([*b.columns[:7], *map(pa.array, sums), *rest], [c.split()[0] for c in KNOWN.split(", ")])

    return done.mapInArrow(run, KNOWN)


def totals(done: DataFrame, rates: DataFrame, most: int = TABLE) -> DataFrame:
    """row, FACTS, n_best (links whose count is their A id's highest) and count_sum (of counts, over links) of every text."""
    table, least = frequent(done.sparkSession, rates, most)
    known = cut(looked_up(done, table), "known")
    missed = known.filter(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    sums = missed.join(rates.filter(F.col("docs") < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    parts = known.drop("pairs", "times").unionByName(sums, allowMissingColumns=True)
    return parts.groupBy("row").agg(*[F.max(c).alias(c) for c in FACTS], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def report(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, most: int = TABLE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs."""
    done, width = aligned(docs, path_a, path_b)
    done = cut(done, "aligned")
    rates = cut(rated(cut(pair_counts(done), "pairs"), width), "rates")
    return totals(done, rates, most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
