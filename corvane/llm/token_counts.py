"""Token counts without shuffling pre-tokens: a map-side lookup in two tiers.

Tier one is a compact table, broadcast to every executor, of the lengths of
frequent pre-tokens: the vocabulary's own entries that are whole pre-tokens, in
rank order, which is the order of frequency they were learned in. It needs no
pass over the corpus and has at most TABLE entries, whatever the input. Tier two
is each worker's bounded memory: misses are encoded once by merge ranks (or by the
library, where ranks do not serve) and kept. Nothing is shuffled.

Defined cases: null text is empty and has no tokens; special strings in a text
count as the library counts them by default; other columns are ignored; every
row is counted by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm import vocab

TABLE, HELD = 40_000, 150_000


def frequent_lengths(tok, most: int = TABLE) -> tuple[bytes, bytes]:
    """The table: pre-tokens joined by zero bytes, and one byte of length each."""
    pre = tok.pre_tokenizer
    words = []
    for i in range(tok.get_vocab_size(with_added_tokens=False)):
        word = tok.decode([i], skip_special_tokens=False)
        if word and "\x00" not in word and "�" not in word and len(pre.pre_tokenize_str(word)) == 1:
            words.append(word)
        if len(words) == most:
            break
    lengths = [len(e.ids) for e in tok.encode_batch(words, add_special_tokens=False)]
    fit = [(w, n) for w, n in zip(words, lengths) if n < 256]
    return "\x00".join(w for w, _ in fit).encode(), bytes(n for _, n in fit)


class Counter:
    """text -> its number of tokens. A text is cut before single spaces and at line ends, where pre-tokens always part; such a part is mostly one pre-token."""

    def __init__(self, shipped: tuple[bytes, bool], table: tuple[bytes, bytes]):
        self.encoder = vocab.encoder(shipped)
        tok = self.encoder.tok
        self.bare = dict(zip(table[0].decode().split("\x00"), table[1])) if table[1] else {}
        self.spaced = {w[1:]: n for w, n in self.bare.items() if w[0] == " " and len(w) > 1}
        self.heads = vocab.Remembered(lambda w: len(self.encoder(w)), 20_000)
        self.memory: dict[str, int] = {}
        space = vocab.byte_characters()[0x20]
        self.opens = np.array([(tok.id_to_token(i) or "").startswith(chr(space)) for i in range(tok.get_vocab_size())])
        self.met = self.first = self.second = 0  # pre-tokens, and those either tier knew

    def learn(self, words: list[str]) -> None:
        """Put the lengths of words, each after a space, into the memory: all encoded at once, and parted where a token begins with the space."""
        ids = self.encoder(" " + " ".join(words))
        begin = np.flatnonzero(self.opens[ids])
        if len(begin) != len(words):  # signs with spaces of their own: one by one
            lengths = [len(self.encoder(" " + w)) for w in words]
        else:
            lengths = np.diff(begin, append=len(ids)).tolist()
        if len(self.memory) > HELD:
            self.memory = {}
        self.memory.update(zip(words, lengths))

    def __call__(self, text: str) -> int:
        if any(m in text for m in self.encoder.marks):
            return len(self.encoder(text))
        words, n, end = [], 0, self.heads["\n"]
        for k, line in enumerate(text.split("\n")):
            own = line.split(" ")
            if "" in own or not line.isprintable():  # runs of white space, or unusual characters
                return len(self.encoder(text))
            head = self.bare.get(own[0])
            n += (end if k else 0) + (self.heads[own[0]] if head is None else head)
            words += own[1:]
        lengths = list(map(self.spaced.get, words))
        missed = [w for w, x in zip(words, lengths) if x is None]
        self.met, self.first = self.met + len(words), self.first + len(words) - len(missed)
        new = [w for w in dict.fromkeys(missed) if w not in self.memory]
        if new:
            self.learn(new + [w for w in dict.fromkeys(missed) if w in self.memory] if len(self.memory) > HELD else new)
        self.second += len(missed) - len(new)
        return n + sum(x for x in lengths if x is not None) + sum(map(self.memory.__getitem__, missed))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs."""
    spark = docs.sparkSession
    path = path or vocab.default_path("byte_bpe_50k.json")
    sent = vocab.ship(spark, path)
    table = spark.sparkContext.broadcast(frequent_lengths(vocab.load(sent.value[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = vocab.once("counts", hash(sent.value[0]), lambda: Counter(sent.value, table.value))
        for b in batches:
            size, n = [], []
            for x in b.column("text"):
                text = x.as_py() or ""
                size.append(len(text.encode()))
                n.append(count(text))
            n = np.array(n, dtype="int64")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
