"""BPE encoding by content-defined chunks, and decoding.

A rolling hash over the last WINDOW characters cuts every text where its low bits
are zero, so a passage shared by two documents is cut alike in both. Each worker
encodes a chunk the first time it meets it and keeps the ids (HELD characters in
each of two generations); a chunk met again costs one lookup. Chunks are not
exchanged between workers: hashes, texts and ids of the shared ones would have to
be joined to documents twice, which moves more bytes than the texts have.

A cut can fall inside a word, so a chunk's ids are used from its first to its last
space between two other characters, where the tokenizer always starts a new piece.
Each join is repaired: the text from the last but one space before the cut to the
second one after it is encoded again, and must agree with both chunks' ids of the
whole words at its ends. Where it does not, and where a chunk has fewer than four
such spaces, the window grows over whole chunks, until there is agreement or the
text ends.

Defined cases: null text is empty and has no ids; white space alone has none for
word vocabularies; very long texts are cut like others; repeated rows are encoded
each; other columns are ignored (encode_table) or kept (with_ids), where input
columns named ids or decoded are replaced by the results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm import vocab

WINDOW, BITS, GROUP = 16, 8, 128
HELD, LONGEST = 4_000_000, 8192


def cuts(chars: np.ndarray) -> np.ndarray:
    """Positions after which the text is cut: a polynomial hash of the last 16 characters, made by doubling the window four times."""
    h, p, w = (chars + np.uint32(1)) * np.uint32(2654435761), 0x01000193, 1
    while w < WINDOW:
        h = h.copy()
        h[w:] += np.uint32(pow(p, w, 1 << 32)) * h[:-w].copy() if len(h) > w else np.uint32(0)
        w *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return np.flatnonzero((h >> np.uint32(32 - BITS)) == 0)


def spaces(c: str) -> tuple[int, int, int, int] | None:
    """The first two and the last two places of a space between two other characters; None if they are fewer than four."""

    def walk(find, start: int, step: int) -> Iterator[int]:
        while start >= 0:
            if 0 < start < len(c) - 1 and not c[start - 1].isspace() and not c[start + 1].isspace():
                yield start
            start = find(start + step)

    right = walk(lambda p: c.find(" ", p), c.find(" "), 1)
    left = walk(lambda p: c.rfind(" ", 0, p), c.rfind(" "), 0)
    found = [next(right, -1), next(right, -1), next(left, -1), next(left, -1)]
    a, b, z, y = found
    return (a, b, y, z) if min(found) >= 0 and b < y else None


class Chunk(NamedTuple):
    """ids from a chunk's first to its last space, beginning with those of the word first and ending with those of the word last; head and tail: its text up to the second and from the last but one space."""

    ids: bytes
    head: str
    first: bytes
    tail: str
    last: bytes


class Chunks:
    """Encodes texts with one tokenizer; lives as long as its worker's stage."""

    def __init__(self, encoder):
        self.bytes = lambda text: encoder(text).tobytes()
        self.word = vocab.Remembered(self.bytes, 20_000)
        self.marks = encoder.marks
        self.young: dict[str, Chunk | None] = {}
        self.old: dict[str, Chunk | None] = {}
        self.held = self.met = self.reused = self.joined = self.grown = 0

    def chunk(self, c: str) -> Chunk | None:
        """None: too few spaces."""
        self.met += 1
        kept = self.young if c in self.young else self.old
        if c in kept:
            self.reused += 1
            got = kept[c]
        else:
            got = self.fresh(c)
        if len(c) <= LONGEST and kept is not self.young:
            if self.held > HELD:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[c] = got
            self.held += len(c)
        return got

    def fresh(self, c: str) -> Chunk | None:
        at = spaces(c)
        if at is None:
            return None
        a, b, y, z = at
        ids, first, last = self.bytes(c[a:z]), self.word[c[a:b]], self.word[c[y:z]]
        return Chunk(ids, c[:b], first, c[y:], last) if ids.startswith(first) and ids.endswith(last) else None

    def join(self, last: bytes, tail: str, head: str, first: bytes) -> bytes | None:
        """The ids between the words last, where tail begins, and first, where head ends; None without agreement."""
        ids = self.bytes(tail + head)
        self.joined += 1
        if len(ids) < len(last) + len(first) or not ids.startswith(last) or not ids.endswith(first):
            return None
        return ids[len(last) : len(ids) - len(first)]

    def encode(self, pieces: list[str]) -> bytes:
        out: list[bytes] = []
        last, tail, loose = b"", "", ""  # of the chunk before; text that no chunk has taken yet
        for c in pieces:
            new = self.chunk(c)
            if loose:
                loose += c
                new = new and self.fresh(loose)
            window = new and self.join(last, tail, new.head, new.first)
            if window is None:
                self.grown += new is not None
                loose = loose or c
                continue
            out += [window, new.ids]
            last, tail, loose = new.last, new.tail, ""
        out.append(self.bytes(tail + loose)[len(last) :])  # a space is where tail begins, so its first word's ids come first
        return b"".join(out)

    def encode_texts(self, texts: list[str]) -> Iterator[bytes]:
        """The texts are hashed together; a gap of constant characters keeps each text's cuts its own. Texts with a special string are encoded whole."""
        gap = "\x00" * WINDOW
        whole = gap + gap.join(texts)
        at = cuts(np.frombuffer(whole.encode("utf-32-le"), dtype="<u4").astype(np.uint32)) + 1
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        lows = np.cumsum(sizes + WINDOW)
        begin, ends = np.searchsorted(at, lows - sizes, side="right"), np.searchsorted(at, lows, side="left")
        for t, low, a, z in zip(texts, (lows - sizes).tolist(), begin.tolist(), ends.tolist()):
            if any(m in t for m in self.marks):
                yield self.bytes(t)
                continue
            marks = [0, *(at[a:z] - low).tolist(), len(t)]
            yield self.encode([t[i:j] for i, j in zip(marks, marks[1:]) if j > i])


def with_ids(docs: DataFrame, path: str | None = None, decode: bool = False, digest: bool = False) -> DataFrame:
    """docs with the column ids (binary, little-endian unsigned 32-bit) and, if asked for, decoded; with digest, doc_id, n_tokens, ids_sha256, decoded_sha256 only."""
    path = path or vocab.default_path("word_bpe_49k.json")
    sent = vocab.ship(docs.sparkSession, path)
    names = ["doc_id"] if digest else [c for c in docs.columns if c not in ("ids", "decoded")]
    made = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids binary" + ", decoded string" * decode
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c in names), made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = sent.value[0]
        coder = vocab.once("chunks", hash(content), lambda: Chunks(vocab.encoder(sent.value)))
        text_of = vocab.once("decoder", hash(content), lambda: vocab.Decoder(content))
        for whole in batches:
            for k in range(0, whole.num_rows, GROUP):
                b = whole.slice(k, GROUP)
                ids = list(coder.encode_texts([x or "" for x in b.column("text").to_pylist()]))
                cols = [b.column(c) for c in names]
                if not digest and not decode:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary())], [*names, "ids"])
                    continue
                texts = (text_of(np.frombuffer(x, dtype="<u4")) for x in ids)
                if digest:
                    decoded = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
                    cols += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(decoded, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, [*names, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary()), pa.array(list(texts), pa.string())], [*names, "ids", "decoded"])

    picked = docs.select("doc_id", "text") if digest else docs.select(*[f"`{c}`" for c in names])
    return picked.mapInArrow(run, schema)


def encode_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    return with_ids(docs, path, digest=True)
