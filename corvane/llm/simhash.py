"""SimHash near duplicates by meeting in the middle.

Two fingerprints that differ in at most 2 * HALF bits have a common variant within
HALF bits of each. So every distinct fingerprint stands for all its variants with up
to HALF bits flipped (2,081 of 64 bits), and variants are shuffled: any two owners of
one variant are linked.

Rows of (variant, owner) would be 2,081 a fingerprint. A variant's bucket is a linear
function of its bits (the exclusive or of one code per set bit), so the flips that
take a fingerprint's variants into a bucket depend on its own code alone. A
fingerprint is sent once to every bucket that holds a variant of it, and the bucket's
task unfolds just the variants that belong there, one further code (at most about
SLICE variants) at a time. With 64 buckets the codes are the bits' own numbers, each
bucket holds 33 variants of nearly every fingerprint, and 64 rows leave one; where a
bucket would hold more than BUCKET fingerprints, buckets double (at most 2,081 rows).

In a bucket, owners of a variant make a star round the least of them; colliding pairs
are made distinct, verified by their differing bits, and only those that join two
parts of the bucket leave the task, so a large group of near copies costs as many
rows as it has members, not their square. Components follow.

Defined cases: null, empty and wordless texts have fingerprint zero and are linked
like others; a text with fewer words than a shingle is one shingle; repeated rows and
equal texts are one fingerprint and come out once a row; rows with a null doc_id link
others but are nobody's component; an empty table gives an empty one; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import components
from corvane.llm.scratch import cut

BITS = 64
BUCKET, SLICE = 1 << 24, 1 << 22
CHUNK = 1 << 14
SALT = 8


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words; linked at `half` * 2 differing bits or fewer."""

    words: int = 4
    half: int = 2
    seed: int = 42


def fingerprint(text: str | None, rule: Rule = Rule()) -> int:
    """bytes.lower() and bytes.split() know A-Z and the six ASCII blanks only."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), rule.words
    ends = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = (ends + 1).cumsum() - 1
    if len(words) <= k:
        spans = [(0, len(joined))]
    else:
        begin = np.concatenate([[0], ends[:-k] + 1])
        spans = list(zip(begin.tolist(), ends[k - 1 :].tolist()))
    total = np.zeros(BITS, dtype=np.int64)
    digest, seed = xxhash.xxh64_intdigest, rule.seed
    for at in range(0, len(spans), CHUNK):
        h = np.array([digest(joined[a:z], seed) for a, z in spans[at : at + CHUNK]], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(x.as_py(), rule) for x in b.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def flips(half: int) -> np.ndarray:
    """All masks of at most `half` bits."""
    one = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    out, layer = [np.zeros(1, dtype=np.uint64)], np.zeros(1, dtype=np.uint64)
    for _ in range(half):
        more = layer[:, None] ^ one[None, :]
        layer = np.unique(more[more > layer[:, None]])
        layer = layer[np.bitwise_count(layer) == len(out)]
        out.append(layer)
    return np.concatenate(out)


class Code:
    """A linear code of fingerprints: its low bits name the bucket, the rest slice the bucket."""

    def __init__(self, n: int, half: int):
        self.flips = flips(half)
        self.low, self.high = 6, 0
        while n * min(len(self.flips), 1 << self.low) >> self.low > BUCKET:
            self.low += 1
        while n * len(self.flips) >> (self.low + self.high) > SLICE:
            self.high += 1
        at = np.arange(BITS, dtype=np.uint64)
        extra = (at + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 32)
        self.columns = (at | extra << np.uint64(6)) & np.uint64((1 << (self.low + self.high)) - 1)
        self.of_flips = self(self.flips)
        self.reach = np.unique(self.of_flips & np.uint64((1 << self.low) - 1))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.uint64)
        for i in range(BITS):
            out ^= self.columns[i] * (x >> np.uint64(i) & np.uint64(1))
        return out

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """For each fingerprint, the buckets that hold its variants."""
        return (self(x) & np.uint64((1 << self.low) - 1))[:, None] ^ self.reach[None, :]


def _collisions(x: np.ndarray, code: Code, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints with a common variant of code `target`: the least owner of each variant with every other. x is sorted by code."""
    own = code(x)
    want = np.uint64(target) ^ code.of_flips
    low, high = np.searchsorted(own, want, "left"), np.searchsorted(own, want, "right")
    some = np.flatnonzero(high > low)
    if not len(some):
        return x[:0], x[:0]
    variants = np.concatenate([x[low[i] : high[i]] ^ code.flips[i] for i in some])
    order = np.sort(variants)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return x[:0], x[:0]
    at = np.minimum(np.searchsorted(twice, variants), len(twice) - 1)
    hit = twice[at] == variants
    variants, owners = variants[hit], np.concatenate([x[low[i] : high[i]] for i in some])[hit]
    order = np.lexsort((owners, variants))
    variants, owners = variants[order], owners[order]
    first = np.flatnonzero(np.diff(variants, prepend=variants[0] ^ np.uint64(1)))
    size = np.diff(first, append=len(variants))
    a = np.repeat(owners[first], size)
    pairs = np.unique(np.stack([a, owners])[:, a != owners], axis=1)
    return pairs[0], pairs[1]


def _spanning(rule: Rule, n: int):
    """For one bucket: verified links (a, b) that join all it links, and no more of them than that takes."""

    def run(table: pa.Table) -> pa.Table:
        code = Code(n, rule.half)
        bucket = int(table.column("bucket")[0].as_py())
        x = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        x = x[np.argsort(code(x), kind="stable")]
        root: dict[int, int] = {}

        def find(i: int) -> int:
            top = i
            while (up := root.get(top, top)) != top:
                top = up
            while (up := root.get(i, i)) != top:
                root[i], i = top, up
            return top

        a_, b_ = [], []
        for k in range(1 << code.high):
            a, b = _collisions(x, code, bucket | k << code.low)
            near = np.bitwise_count(a ^ b) <= 2 * rule.half
            for p, q in zip(a[near].tolist(), b[near].tolist()):
                s, t = find(p), find(q)
                if s != t:
                    root[max(s, t)] = min(s, t)
                    a_.append(p)
                    b_.append(q)
        out = [pa.array(np.array(z, dtype=np.uint64).view(np.int64)) for z in (a_, b_)]
        return pa.table(out, names=["a", "b"])

    return run


def links(distinct: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """a, b: links between distinct fingerprints (a column fp) that span their components."""
    n = distinct.count()
    code = Code(n, rule.half)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                x = whole.column("fp").slice(at, 1024).to_numpy()
                to = code.buckets(x.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(to.ravel().astype(np.int32)), pa.array(np.repeat(x, to.shape[1]))], ["bucket", "fp"])

    sent = distinct.select("fp").mapInArrow(send, "bucket int, fp bigint")
    sent = sent.repartition(min(4 << code.low, 1 << 14), "bucket")  # few bytes but much work: a stated number, which is not coalesced
    return sent.groupBy("bucket").applyInArrow(_spanning(rule, n), "a bigint, b bigint").distinct()


def grouped(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    prints = cut(fingerprints(docs, rule), "fingerprints")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    comps = components(links(classes, rule)).select(F.col("id").alias("fp"), "root")
    named = cut(classes.join(comps, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")  # one fingerprint may have very many rows
    of_print = named.select("fp", "root").join(least, "root").select("fp", "component_id", salts)
    return prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(of_print, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def report(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row of docs."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return grouped(docs, rule).select("doc_id", hexed.alias("fingerprint"), "component_id")
