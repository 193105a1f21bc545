"""Language identification by a linear-chain conditional random field over words.

Each word has a label; its features are its character n-grams of 1 to 4 with marks
at both ends (so prefixes and suffixes are among them), hashed, and its entry in a
lexicon of words seen often in training. Transitions are learned: training chains
splice spans of several documents, as code-switched text does, so that staying and
switching both occur. Marginals come from the forward-backward algorithm, cut in
segments of SEGMENT words: each segment's matrix product first, then messages from
segment to segment, then inside all segments at once, which is exact and needs no
padding to the longest text; a text's first word has its emission alone, as in the
training chains.

Learned on the driver from at most TRAIN_DOCS labelled documents (a bounded,
documented sample, by hash of doc_id; of a text longer than TRAIN_CHARS, a span of
that length from a place that the hash picks); labels of words are those of their
documents. Whole texts are predicted, map side, nothing
is shuffled.

Defined cases: null text, or none with a letter, gives `und` with score 0; no
labelled rows at all give `und` everywhere; a null doc_id is not held out and not
learned from; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import vocab

TRAIN_DOCS, TRAIN_CHARS, SPANS, SPAN, LEXICON = 2500, 20_000, 6, 12, 20_000
GRAMS, HASHED, ROUNDS, SEGMENT = 4, 1 << 15, 60, 64


def letters(raw: str) -> str:
    return raw if raw.isalpha() else "".join(filter(str.isalpha, raw))


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all words, where each word's begin). Every word has some."""
    text = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(len(text))
    owner = np.repeat(np.arange(len(words)), size)
    numbers, owners, h = [], [], np.zeros(len(text), dtype=np.uint64)
    for n in range(1, GRAMS + 1):
        h = h[: len(text) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + text[n - 1 :] + np.uint64(n)
        inside = at[: len(h)] + n <= end[: len(h)]
        x = h[inside]
        numbers.append(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    known = [(i, HASHED + lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    numbers.append(np.array([k for _, k in known], dtype=np.int64))
    owners.append(np.array([i for i, _ in known], dtype=np.int64))
    numbers, owners = np.concatenate(numbers), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return numbers[order], np.searchsorted(owners[order], np.arange(len(words)))


def emissions(words: list[str], lexicon: dict[str, int], weights: np.ndarray) -> np.ndarray:
    numbers, begin = features(words, lexicon)
    count = np.diff(np.append(begin, len(numbers)))
    return np.add.reduceat(weights[numbers], begin, axis=0) / np.sqrt(count)[:, None]


def forward_backward(score: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chains, length, labels) and expected moves, for chains of one length."""
    n, length, k = score.shape
    p, t = np.exp(score - score.max(axis=2, keepdims=True)), np.exp(move)
    a = np.zeros_like(p)
    a[:, 0] = p[:, 0]
    for i in range(length):
        if i:
            a[:, i] = (a[:, i - 1] @ t) * p[:, i]
        a[:, i] /= a[:, i].sum(axis=1, keepdims=True)
    b, out, moves = np.ones((n, k)), np.zeros_like(p), np.zeros((k, k))
    for i in range(length - 1, -1, -1):
        m = a[:, i] * b
        out[:, i] = m / m.sum(axis=1, keepdims=True)
        if i:
            pb = p[:, i] * b
            joint = a[:, i - 1][:, :, None] * t * pb[:, None, :]
            moves += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = pb @ t.T
            b /= b.sum(axis=1, keepdims=True)
    return out, moves


def learn(rows: list[tuple[str, str]], seed: int = 3) -> tuple[list[str], dict[str, int], np.ndarray, np.ndarray] | None:
    """(labels, lexicon, feature weights, transition weights) from (text, lang) rows; None if there are no words."""
    texts = [([w for w in map(letters, t.lower().split()) if w], lang) for t, lang in rows]
    texts = [(w, lang) for w, lang in texts if w]
    if not texts:
        return None
    labels = sorted({lang for _, lang in texts})
    rng = np.random.default_rng(seed)
    chains, gold = [], []
    by_label = {lang: [w for w, x in texts if x == lang] for lang in labels}
    for _ in range(max(600, len(texts))):
        words, tags = [], []
        lang = labels[rng.integers(len(labels))]
        for _ in range(SPANS):
            own = by_label[lang]
            doc = own[rng.integers(len(own))]
            k = int(rng.integers(0, max(1, len(doc) - SPAN + 1)))
            piece = doc[k : k + SPAN]
            piece = (piece * SPAN)[:SPAN]
            words += piece
            tags += [labels.index(lang)] * SPAN
            if rng.random() < 0.3:
                lang = labels[rng.integers(len(labels))]
        chains.append(words)
        gold.append(tags)
    counts = Counter(w for words, _ in texts for w in words)
    lexicon = {w: i for i, (w, c) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) if c >= 3}
    types = sorted({w for c in chains for w in c})
    number = {w: i for i, w in enumerate(types)}
    feats, begin = features(types, lexicon)
    size = np.diff(np.append(begin, len(feats)))
    scale = 1 / np.sqrt(size)
    owner = np.repeat(np.arange(len(types)), size)
    x, y = np.array([[number[w] for w in c] for c in chains]), np.array(gold)
    k, flat = len(labels), x.ravel()
    weights, move = np.zeros((HASHED + len(lexicon), k)), np.zeros((k, k))
    gw, gm = np.full_like(weights, 1e-8), np.full_like(move, 1e-8)
    truth = np.eye(k)[y]
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    for _ in range(ROUNDS):
        e = np.add.reduceat(weights[feats], begin, axis=0) * scale[:, None]
        m, moves = forward_backward(e[x], move)
        diff = (truth - m).reshape(-1, k)
        per_type = np.stack([np.bincount(flat, diff[:, j], len(types)) for j in range(k)], axis=1) * scale[:, None]
        grad = np.stack([np.bincount(feats, per_type[owner, j], len(weights)) for j in range(k)], axis=1) / len(flat) - 1e-6 * weights
        gmove = (seen - moves) / len(flat) - 1e-6 * move
        gw, gm = gw + grad**2, gm + gmove**2
        weights += 0.5 * grad / np.sqrt(gw)
        move += 0.5 * gmove / np.sqrt(gm)
    return labels, lexicon, weights.astype(np.float32), move.astype(np.float32)


class Tagger:
    """Predicts with one model; emissions of words are remembered."""

    def __init__(self, model, most: int = 250_000):
        self.labels, self.lexicon, self.weights, move = model
        self.move = np.exp(move - move.max()).astype(np.float64)
        self.most, self.rows, self.number = most, [np.zeros((1, len(self.labels)))], {}
        self.table = self.rows[0]

    def word_numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Row of the emission table for each raw word; 0 for those without letters."""
        new = list(set().union(*texts) - self.number.keys()) if texts else []
        if new:
            if len(self.number) + len(new) > self.most:
                self.number, self.table = {}, np.zeros((1, len(self.labels)))
                new = list(set().union(*texts))
            clean = [letters(w) for w in new]
            own = [w for w in clean if w]
            if own:
                row = iter(range(len(self.table), len(self.table) + len(own)))
                self.table = np.concatenate([self.table, emissions(own, self.lexicon, self.weights)])
            self.number.update((raw, next(row) if w else 0) for raw, w in zip(new, clean))
        return [np.fromiter(map(self.number.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts]

    def marginals(self, texts: list[str | None], keep: bool = False):
        """Sums of the words' marginals (texts, labels), numbers of words and, with keep, the marginals of each text's words."""
        ids = self.word_numbers([(t or "").lower().split() for t in texts])
        ids = [x[x > 0] for x in ids]
        k, t = len(self.labels), self.move
        segs = np.array([-(-len(x) // SEGMENT) for x in ids], dtype=np.int64)
        first, total = np.cumsum(segs) - segs, int(segs.sum())
        sums = np.zeros((len(texts), k))
        if not total:
            return sums, np.array([len(x) for x in ids]), [np.zeros((0, k))] * len(ids)
        grid = np.zeros((total, SEGMENT), dtype=np.int64)
        for x, f, n in zip(ids, first, segs):
            if n:
                grid[f : f + n].ravel()[: len(x)] = x
        real = grid > 0
        e = self.table[grid]
        p = np.exp(e - e.max(axis=2, keepdims=True))
        head = np.zeros(total, dtype=bool)  # segments that begin a text: nothing moves into their first word
        head[first[segs > 0]] = True
        m = np.broadcast_to(np.eye(k), (total, k, k)).copy()  # each segment's product
        for i in range(SEGMENT):
            on = real[:, i]
            if not on.any():
                break
            step = (m.reshape(-1, k) @ t).reshape(total, k, k)
            if not i:
                step[head] = m[head]
            step = step * p[:, i][:, None, :]
            step /= step.sum(axis=(1, 2), keepdims=True)
            m = np.where(on[:, None, None], step, m)
        start, finish = np.full((total, k), 1 / k), np.ones((total, k))
        for i in range(1, int(segs.max())):  # from segment to segment, all texts at once
            at = first[segs > i] + i
            a = np.einsum("ni,nij->nj", start[at - 1], m[at - 1])
            start[at] = a / a.sum(axis=1, keepdims=True)
        for i in range(int(segs.max()) - 2, -1, -1):
            at = first[segs > i + 1] + i
            b = np.einsum("nij,nj->ni", m[at + 1], finish[at + 1])
            finish[at] = b / b.sum(axis=1, keepdims=True)
        a, b = start, finish
        kept = np.zeros((total, SEGMENT, k))
        for i in range(SEGMENT):
            step = a @ t
            if not i:
                step[head] = a[head]
            step = step * p[:, i]
            step /= step.sum(axis=1, keepdims=True)
            a = np.where(real[:, i : i + 1], step, a)
            kept[:, i] = a
        for i in range(SEGMENT - 1, -1, -1):
            x = kept[:, i] * b
            kept[:, i] = x / x.sum(axis=1, keepdims=True) * real[:, i : i + 1]
            step = (p[:, i] * b) @ t.T
            step /= step.sum(axis=1, keepdims=True)
            b = np.where(real[:, i : i + 1], step, b)
        some = segs > 0
        sums[some] = np.add.reduceat(kept.sum(axis=1), first[some], axis=0)
        words = [kept[f : f + n].reshape(-1, k)[: len(x)] for x, f, n in zip(ids, first, segs)] if keep else None
        return sums, np.array([len(x) for x in ids]), words


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """The bounded sample: the TRAIN_DOCS labelled, not held-out documents whose doc_id hashes lowest."""
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("_h"), "doc_id")
    # a share of the hash space that holds a little more than the sample, so that tasks send few texts to be ranked
    share = min(1.0, 1.5 * TRAIN_DOCS / max(usable.count(), 1) + 1e-9)
    low = usable.filter(F.shiftrightunsigned("_h", 11) < int(share * (1 << 53)))
    long = F.length("text") > TRAIN_CHARS
    at = F.pmod("_h", F.greatest(F.length("text") - TRAIN_CHARS, F.lit(1))).cast("int") + 1
    span = F.when(long, F.substring("text", at, F.lit(TRAIN_CHARS))).otherwise(F.col("text"))
    rows = low.select(span.alias("text"), long.alias("long"), "lang", "_h", "doc_id").orderBy(F.shiftrightunsigned("_h", 11), "doc_id").limit(TRAIN_DOCS).collect()
    # a span's first and last words may be cut
    return [(" ".join(r.text.split()[1:-1]) if r.long else r.text, r.lang) for r in rows]


def fitted(docs: DataFrame):
    return docs.sparkSession.sparkContext.broadcast(learn(training_rows(docs)))


def predict(docs: DataFrame, model=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    import uuid

    sent, mark = model or fitted(docs), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = vocab.once("tagger", mark, lambda: sent.value and Tagger(sent.value))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
                if tagger:
                    sums, n, _ = tagger.marginals(b.column("text").to_pylist())
                    best = sums.argmax(axis=1)
                    score = np.where(n > 0, sums[np.arange(len(n)), best] / np.maximum(n, 1), 0.0)
                    lang = [tagger.labels[j] if c else "und" for j, c in zip(best, n)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, model=None) -> DataFrame:
    """doc_id and words: per word with letters, in order, its label and the label's marginal."""
    import uuid

    sent, mark = model or fitted(docs), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = vocab.once("tagger", mark, lambda: sent.value and Tagger(sent.value))
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                texts, out = b.column("text").to_pylist(), []
                words = tagger.marginals(texts, keep=True)[2] if tagger else [np.zeros((0, 1))] * len(texts)
                for t, m in zip(texts, words):
                    own = [w for w in (t or "").lower().split() if letters(w)]
                    out.append([{"word": w, "lang": tagger.labels[int(r.argmax())], "score": float(r.max())} for w, r in zip(own, m)])
                kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind)], ["doc_id", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, words array<struct<word:string,lang:string,score:double>>")
