"""Benchmark decontamination by latent semantic retrieval.

The benchmark is a stated query set. Document frequencies of all its words are
counted in one pass over the documents (one for every VOCABULARY words), map side
first. Its passages (items cut at PASSAGE words) then go through in blocks of at
most ITEMS passages and WORDS distinct words, GROUP blocks to a pass over the
documents, so that what is sent to executors is bounded whatever its size; the
driver holds its distinct words. For each block:

1. A word's weight is ln(COMMON * n / df), none if negative. Passages leaked so
   often that their own words count as common (mean squared weight under WORN) are
   besides looked up by SEED-word runs, and the stretch of text that a run aligns
   with the passage goes to the check of step 4.
2. The passages are a distributed TF-IDF matrix; a randomised SVD (random range, two
   power iterations, each a map over passages and a sum by slice of the vocabulary)
   gives the latent space.
3. Every document is cut into overlapping windows of three STEP-word blocks, so
   that any passage lies whole in one of them; windows are folded into the latent
   space and their cosine with every passage is taken, in matrix blocks.
4. Windows of cosine MIN_COSINE or more, whose part along the passage is MIN_HELD of
   the passage's length or more (two rare words by chance are not), are compared word by word: the longest
   common subsequence must have SHARE of the passage's words, and its last quarter,
   where an item has its answer, ANSWER of its own.

Items of fewer than LEAST words say too little for a latent space: they are found
where all their words stand in a row. Pieces of longer items never get that short.

A window never leaves its task and nothing of the corpus is shuffled but counts of
benchmark words. Words are lower-cased and stripped of signs at both ends; in
scripts that are written without spaces each character is a word.

Defined cases: null text or item text has no words and matches nothing; items
without an id are looked for and come out with null item_id, those that share an id
are one item of several passages (one of more than GROUP blocks may come out once a
pass); repeated rows are matched each; an empty benchmark or table gives an empty
result; other columns are ignored (matches) or kept (keep_clean).
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import vocab
from corvane.llm.scratch import cut, let_go

ITEMS, WORDS, GROUP, VOCABULARY = 1024, 1 << 14, 4, 1 << 18
PASSAGE, STEP, LEAST, RANK = 64, 32, 6, 256
WORN, SEED = 0.25, 3
COMMON, MIN_COSINE, MIN_HELD, SHARE, ANSWER = 0.1, 0.35, 0.25, 0.6, 0.5
SLICE = 4096
_EDGE = re.compile(r"^\W+|\W+$")
#: What _EDGE takes off, up to U+00FF.
_SIGNS = "".join(c for c in map(chr, range(256)) if _EDGE.match(c))
#: First byte of U+0100 in UTF-8; characters below have the same white space, case and signs in Arrow.
_BEYOND = 0xC4


#: Thai, Lao, Myanmar, Khmer, kana and Han
_SOLID = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def spaced(text: str | None) -> list[str]:
    """The parts of a text between white space, in lower case; characters of scripts without spaces by themselves."""
    text = (text or "").lower()
    try:
        text.encode("latin-1")  # much the faster test
    except UnicodeEncodeError:
        text = _SOLID.sub(r" \1 ", text)
    return text.split()


def words_of(text: str | None) -> list[str]:
    return [w for w in (_EDGE.sub("", x) for x in spaced(text)) if w]


def few_signs(texts: pa.Array) -> np.ndarray:
    """Which texts have no character beyond U+00FF."""
    if not len(texts):
        return np.zeros(0, dtype=bool)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    beyond = np.flatnonzero(np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] >= _BEYOND) + at[0] if data else np.zeros(0, dtype=np.int64)
    return np.diff(np.searchsorted(beyond, at)) == 0


class Ids(dict):
    """raw word -> its number in the vocabulary: -1 for other words, -2 for signs only."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers
        self.words = pa.array(list(numbers), pa.string())
        self.places = np.array([*numbers.values(), -1], dtype=np.int32)

    def __missing__(self, raw: str) -> int:
        word = raw if raw.isalnum() else _EDGE.sub("", raw)
        got = self.numbers.get(word, -1) if word else -2
        if len(self) >= 250_000:
            self.clear()
        self[raw] = got
        return got

    def of(self, text: str | None) -> np.ndarray:
        raw = spaced(text)
        ids = np.fromiter(map(self.__getitem__, raw), dtype=np.int32, count=len(raw))
        return ids[ids != -2]

    def of_all(self, texts: pa.Array) -> list[np.ndarray]:
        """of() every text; those without characters beyond U+00FF go through Arrow together."""
        texts = texts.cast(pa.string()).fill_null("")
        plain = few_signs(texts)
        parts = pc.utf8_split_whitespace(pc.utf8_lower(texts.filter(pa.array(plain))))
        words = pc.utf8_trim(parts.flatten(), characters=_SIGNS)
        some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
        at = pc.index_in(words, value_set=self.words).fill_null(len(self.words)).to_numpy(zero_copy_only=False)
        ids = self.places.take(at[some])
        before = np.concatenate([[0], np.cumsum(some)])
        ends = before[np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)]
        found = iter(np.split(ids, ends[:-1]) if len(ends) else [])
        return [next(found) if p else self.of(t.as_py()) for p, t in zip(plain.tolist(), texts)]


def passages(item_id: int | None, text: str | None) -> list[tuple[int | None, list[str]]]:
    """(item_id, words) of an item, a long one cut in like pieces of PASSAGE words at most."""
    w = words_of(text)
    n = max(1, -(-len(w) // PASSAGE))
    size = max(1, -(-len(w) // n))
    return [(item_id, w[k : k + size]) for k in range(0, len(w), size)]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The benchmark's passages by item_id, null ones first, in blocks; a partition of it is on the driver at a time."""
    found: list[tuple] = []
    known: set[str] = set()
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    for r in rows.orderBy(F.col("item_id").asc_nulls_first(), "text").toLocalIterator():
        for p in passages(r.item_id, r.text):
            if found and (len(found) == ITEMS or len(known | set(p[1])) > WORDS):
                yield found
                found, known = [], set()
            found.append(p)
            known.update(p[1])
    if found:
        yield found


def document_frequency(docs: DataFrame, benchmark: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of documents and, per word of the benchmark, of those that hold it."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for x in b.column("text") for w in words_of(x.as_py())}), pa.string())], ["word"])

    words = sorted(r.word for r in benchmark.select("text").mapInArrow(split, "word string").distinct().toLocalIterator())
    n, out = 0, {}
    for k in range(0, max(1, len(words)), VOCABULARY):
        some = words[k : k + VOCABULARY]
        sent, mark = docs.sparkSession.sparkContext.broadcast(some), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, mark=mark) -> Iterator[pa.RecordBatch]:
            ids = vocab.once("benchmark words", mark, lambda: Ids({w: i for i, w in enumerate(sent.value)}))
            n, width = 0, max(1, len(sent.value))
            seen = np.zeros(len(sent.value), dtype=np.int64)
            for whole in batches:
                for k in range(0, whole.num_rows, BATCH):
                    found = ids.of_all(whole.column("text").slice(k, BATCH))
                    n += len(found)
                    word = np.concatenate(found)
                    row = np.repeat(np.arange(len(found), dtype=np.int64) * width, [len(x) for x in found])
                    keys = np.sort((row + word)[word >= 0])
                    seen += np.bincount(keys[np.diff(keys, prepend=-1) > 0] % width, minlength=len(seen))[: len(seen)]
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at]).astype(np.int64)), pa.array(np.concatenate([[n], seen[at]]).astype(np.int64))], ["word", "n"])

        for r in docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect():  # one row per benchmark word
            if r.word < 0:
                n = r.n
            else:
                out[some[r.word]] = r.n
        sent.unpersist()
    return n, out


def latent_space(spark, rows: list[tuple[list[int], list[float]]], n_words: int, rank: int = RANK) -> np.ndarray:
    """The right singular vectors (n_words x k) of the sparse matrix with these rows (numbers, weights)."""
    k = min(rank, len(rows), n_words)
    wide = min(k + 10, n_words)
    table = spark.createDataFrame([(list(map(int, i)), list(map(float, x))) for i, x in rows], "i array<int>, x array<double>").repartition(max(1, len(rows) // 256))

    def product(m: np.ndarray) -> np.ndarray:
        """A' A m: each task multiplies its rows, slices of the vocabulary are summed apart."""
        sent = spark.sparkContext.broadcast(m.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(sent.value.shape, dtype=np.float64)
            for b in batches:
                for i, x in zip(b.column("i").to_pylist(), b.column("x").to_pylist()):
                    x = np.array(x)
                    out[i] += np.outer(x, x @ sent.value[i])
            cuts = range(0, len(out), SLICE)
            yield pa.RecordBatch.from_arrays([pa.array([c // SLICE for c in cuts], pa.int32()), pa.array([out[c : c + SLICE].tobytes() for c in cuts], pa.binary())], ["slice", "part"])

        def total(t: pa.Table) -> pa.Table:
            s = sum(np.frombuffer(p, dtype=np.float64) for p in t.column("part").to_pylist())
            return pa.table({"slice": t.column("slice").slice(0, 1), "part": pa.array([s.tobytes()], pa.binary())})

        parts = table.mapInArrow(run, "slice int, part binary").groupBy("slice").applyInArrow(total, "slice int, part binary").orderBy("slice").collect()
        return np.concatenate([np.frombuffer(p.part, dtype=np.float64) for p in parts]).reshape(m.shape)

    m = np.random.default_rng(20).standard_normal((n_words, wide))
    for _ in range(3):
        m, _ = np.linalg.qr(product(m))
    small = m.T @ product(m)  # m' A' A m
    value, vector = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-value)[:k]
    return (m @ vector[:, order]).astype(np.float32)


def common_subsequence(masks: dict[int, int], ones: int, window: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel, Hyyro 2004). masks: per word, bits of its places."""
    s = ones
    for w in window:
        m = masks.get(w)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & ones
    return (ones ^ s).bit_count()


def better(old: tuple, new: tuple) -> bool:
    """Whether new has the greater share of its passage's words."""
    return old[0] * new[1] < new[0] * old[1]


class Finder:
    """Finds one block's passages in documents."""

    def __init__(self, found: list[tuple[int, list[int]]], numbers: dict[str, int], weights: np.ndarray, space: np.ndarray):
        self.ids = Ids(numbers)
        self.short: dict[int, dict[int, list[tuple]]] = {}  # number of words -> hash of a run -> items
        for item, w in found:
            if len(w) < LEAST:
                self.short.setdefault(len(w), {}).setdefault(int(self.hashes(np.array(w), len(w))[0]), []).append((item, w))
        found = [(i, w) for i, w in found if len(w) >= LEAST]
        self.items = [i for i, _ in found]
        self.weights = weights
        self.space = space * weights[:, None]
        q = np.array([self.space[w].sum(axis=0) for _, w in found]).reshape(len(found), self.space.shape[1])
        size = np.linalg.norm(q, axis=1, keepdims=True)
        self.q = (q / np.where(size == 0, 1, size)).T.astype(np.float32)
        self.size = np.where(size == 0, 1, size).ravel()
        self.least = max(1, min(3, int(0.5 * min((sum(weights[x] > 0 for x in w) for _, w in found), default=1))))
        self.masks, self.ends = [], []
        for _, w in found:
            tail = max(1, len(w) // 4)
            for words, to in ((w, self.masks), (w[-tail:], self.ends)):
                m: dict[int, int] = defaultdict(int)
                for k, x in enumerate(words):
                    m[x] |= 1 << k
                to.append((dict(m), (1 << len(words)) - 1, len(words)))
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, w) in enumerate(found):
            if np.mean(weights[w] ** 2) < WORN:
                for k, run in enumerate(self.runs(np.array(w)).tolist()):
                    seeds[run].append((i, k))
        self.seeds, self.known_runs = dict(seeds), np.array(sorted(seeds), dtype=np.int64)

    @staticmethod
    def hashes(ids: np.ndarray, n: int) -> np.ndarray:
        """A number for every n words in a row, by which few others go."""
        h = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[k : len(ids) - n + 1 + k].astype(np.int64).astype(np.uint64) + np.uint64(2))
        return h

    def find_short(self, ids: np.ndarray, out: dict) -> None:
        for n, known in self.short.items():
            h = self.hashes(ids, n)
            at = np.flatnonzero(np.isin(h, np.fromiter(known, dtype=np.uint64, count=len(known))))
            for p in at.tolist():
                for item, w in known[int(h[p])]:
                    if item not in out and ids[p : p + n].tolist() == w:
                        out[item] = (n, n, 1.0)

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """A number for every SEED words in a row, -1 where one is not in the vocabulary."""
        at = np.lib.stride_tricks.sliding_window_view(ids.astype(np.int64), SEED) if len(ids) >= SEED else np.zeros((0, SEED), dtype=np.int64)
        return np.where((at >= 0).all(axis=1), at @ (len(self.weights) ** np.arange(SEED, dtype=np.int64)), -1)

    def settle(self, out: dict, i: int, window: list[int], cosine) -> None:
        """Puts passage i in out if the words of a window hold enough of it; cosine() is called then only."""
        masks, ones, n = self.masks[i]
        common = common_subsequence(masks, ones, window)
        if common < SHARE * n:
            return
        masks, ones, tail = self.ends[i]
        if common_subsequence(masks, ones, window) < ANSWER * tail:
            return
        item = self.items[i]
        if item not in out or better(out[item], (common, n)):
            out[item] = (common, n, round(cosine(), 4))

    def find_worn(self, ids: np.ndarray, out: dict) -> None:
        """Passages of common words: each stretch of a text that has a run at the passage's own place, with a quarter's room on both sides."""
        runs = self.runs(ids)
        near = np.searchsorted(self.known_runs, runs)
        at = np.flatnonzero(self.known_runs[np.minimum(near, len(self.known_runs) - 1)] == runs)
        for i, start in sorted({(i, p - k) for p in at.tolist() for i, k in self.seeds[int(runs[p])]}):
            n = self.masks[i][2]
            window = ids[max(0, start - n // 4) : start + n + n // 4]
            self.settle(out, i, window.tolist(), lambda: self.cosine(window, i))

    def cosine(self, window: np.ndarray, i: int) -> float:
        z = self.space[window[window >= 0]].sum(axis=0)
        return float(z @ self.q[:, i] / max(float(np.linalg.norm(z)), 1e-12))

    def block_sums(self, word: np.ndarray, begin: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The sums of the vectors of the words of each block of some: block b has word[begin[b] : begin[b + 1]]."""
        size = begin[some + 1] - begin[some]
        order = np.argsort(-size, kind="stable")
        lo, size = begin[some][order], size[order]
        sums = np.zeros((len(some), self.space.shape[1]), dtype=self.space.dtype)
        for k in range(int(size[0]) if len(size) else 0):  # the k-th words of all blocks that have one, STEP rounds at most
            n = np.searchsorted(-size, -k)
            sums[:n] += self.space[word[lo[:n] + k]]
        out = np.empty_like(sums)
        out[order] = sums
        return out

    def find(self, texts: pa.Array) -> list[dict[int, tuple[int, int, float]]]:
        """Per text: item -> (words in common, words of the passage, cosine) of its best window."""
        out: list[dict] = [{} for _ in range(len(texts))]
        ids = self.ids.of_all(texts)
        if self.seeds:
            for x, o in zip(ids, out):
                self.find_worn(x, o)
        if self.short:
            for x, o in zip(ids, out):
                self.find_short(x, o)
        if not self.items:
            return out
        sizes = np.array([-(-len(x) // STEP) + 2 for x in ids])  # two empty blocks after each text
        first = np.cumsum(sizes) - sizes
        blocks = int(sizes.sum())
        known = [np.flatnonzero((x >= 0) & (self.weights[x] > 0)) for x in ids]
        word = np.concatenate([x[k] for x, k in zip(ids, known)]) if ids else np.zeros(0, dtype=np.int32)
        at = np.concatenate([k // STEP + f for k, f in zip(known, first)]) if ids else np.zeros(0, dtype=np.int64)
        per = np.bincount(at, minlength=blocks + 2)
        hit = np.flatnonzero((per[:-2] + per[1:-1] + per[2:])[:blocks] >= self.least)
        if not len(hit):
            return out
        begin = np.concatenate([[0], np.cumsum(per)])
        doc = np.searchsorted(first, np.arange(blocks), side="right") - 1
        for k in range(0, len(hit), 2048):
            some = hit[k : k + 2048]
            every = np.unique(np.concatenate([some, some + 1, some + 2]))  # windows overlap: a block is summed once
            sums, place = self.block_sums(word, begin, every), np.searchsorted(every, some)
            z = sums[place] + sums[np.searchsorted(every, some + 1)] + sums[np.searchsorted(every, some + 2)]
            size = np.linalg.norm(z, axis=1, keepdims=True)
            cosine = (z / np.where(size == 0, 1, size)) @ self.q
            held = cosine * size >= MIN_HELD * self.size  # the window's part along the passage, against the passage's own length
            for r, i in zip(*np.nonzero((cosine >= MIN_COSINE) & held)):
                d = int(doc[some[r]])
                start = int(some[r] - first[d]) * STEP
                self.settle(out[d], i, ids[d][start : start + 3 * STEP].tolist(), lambda: float(cosine[r, i]))
        return out


def finders(docs: DataFrame, benchmark: DataFrame) -> Iterator[list]:
    """For each pass, of at most GROUP blocks: each block's number, a mark and a broadcast of what Finder() takes."""
    spark = docs.sparkSession
    n, df = document_frequency(docs, benchmark)
    let_go(spark)
    out: list[tuple] = []
    for found in blocks(benchmark):
        if len(out) >= GROUP:
            yield out
            out = []
        words = sorted({w for _, ws in found for w in ws})
        numbers = {w: i for i, w in enumerate(words)}
        held = np.array([df.get(w, 0) for w in words])
        weights = np.maximum(np.log(np.maximum(COMMON * max(n, 1), 1.5) / np.maximum(held, 1)), 0).astype(np.float32)
        coded = [(i, [numbers[w] for w in ws]) for i, ws in found]
        rows = [(list(c), [c[w] * float(weights[w]) for w in c]) for c in (Counter(ws) for _, ws in coded if len(ws) >= LEAST)]
        space = latent_space(spark, rows, len(words)) if rows else np.zeros((len(words), 1), dtype=np.float32)
        out.append((len(out), uuid.uuid4().hex, spark.sparkContext.broadcast((coded, numbers, weights, space))))
    if out:
        yield out


def _finder(sent: tuple) -> Finder:
    block, mark, values = sent
    return vocab.once(f"finder {block}", mark, lambda: Finder(*values.value))


FOUND = "doc_id bigint, item_id bigint, common_words int, item_words int, cosine double"
BATCH = 256


def _matches(docs: DataFrame, sent: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                b = whole.slice(k, BATCH)
                texts, names = b.column("text"), b.column("doc_id").to_pylist()
                best: list[dict] = [{} for _ in names]
                for s in sent:  # an item may have passages in several blocks
                    for old, new in zip(best, _finder(s).find(texts)):
                        old.update({i: x for i, x in new.items() if i not in old or better(old[i], x)})
                rows = [(n, i, *x) for n, f in zip(names, best) for i, x in f.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], ["doc_id", "item_id", "common_words", "item_words", "cosine"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, FOUND)


def _clean(docs: DataFrame, sent: list) -> DataFrame:
    at = f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                b = whole.slice(k, BATCH)
                texts = b.column(at)
                keep = np.ones(len(texts), dtype=bool)
                for s in sent:
                    keep &= np.array([not f for f in _finder(s).find(texts)], dtype=bool)
                yield b.filter(pa.array(keep))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # a name with a dot is no name to mapInArrow
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def _passes(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[list, bool]]:
    """What finders() gives, and whether more follows; what a pass was sent is let go once the next one is asked for."""
    before = None
    for sent in finders(docs, benchmark):
        if before is not None:
            yield before, True
            for *_, b in before:
                b.unpersist()
        before = sent
    if before is not None:
        yield before, False


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, common_words, item_words, cosine: one row per document and item found in it."""
    out = docs.sparkSession.createDataFrame([], FOUND)
    for sent, more in _passes(docs, benchmark):
        found = _matches(docs, sent)
        out = out.unionByName(cut(found, "matches") if more else found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no benchmark item is found."""
    whole = docs
    for sent, more in _passes(whole, benchmark):
        docs = cut(_clean(docs, sent), "clean") if more else _clean(docs, sent)
    return docs
