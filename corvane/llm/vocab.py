"""Exact tokenizer access for executors: the file's content is broadcast (its size is the vocabulary's).

Texts are encoded by merge ranks, the same merges that the library applies: every
entry of the vocabulary is tried once for each file (consistent()), and where each
entry is encoded as itself, the least-ranked pair of neighbours is always a pair of
the file's merges, so ranks alone decide like the list of merges does. Files that
fail the trial, texts with a special string, and lines or words with characters
whose classes, case or normal forms the two regular-expression engines might
take differently, go to the library.
"""

from __future__ import annotations

import ctypes
import json
import os
import re

import numpy as np
from pyspark import TaskContext
from pyspark.sql import SparkSession

WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: How byte-level vocabularies split a text (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same where no two white spaces stand in a row: the part that looks ahead is then one with the last, and without it the engine need not go back.
NO_RUNS = BYTE_LEVEL.replace(r"\s+(?!\S)|", "")
RUN = re.compile(r"\s\s")
#: Up to U+024F classes, case and forms are the same in all engines; but these are ours, or blank to some engines only, or lower-cased into two.
ODD = re.compile("[\x00\x1c-\x1f\u0130\u0250-\U0010ffff]")
#: A line end between two other characters than white space is a piece of its own.
LINE_END = re.compile(f"(?<=[^{WHITE}])(\n)(?=[^{WHITE}])")
UNUSED = "\x00\x00"
_KEPT: dict[str, tuple] = {}
_TRIED: dict[int, bool] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession, path: str):
    """The tokenizer's file as a broadcast, so that executors need no file of their own, and whether ranks decide like its merges."""
    with open(path, "rb") as f:
        content = f.read()
    key = hash(content)
    if key not in _TRIED:
        _TRIED[key] = consistent(content)
        give_back()
    return spark.sparkContext.broadcast((content, _TRIED[key]))


def load(content: bytes):
    """The tokenizer, once for each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"

    def make():
        from tokenizers import Tokenizer

        return Tokenizer.from_str(content.decode())

    return once("tokenizer", hash(content), make)


def once(kind: str, key, make):
    """make() once for each worker and key.

    A new key takes the old one's place. Workers outlive stages: when something is made, all
    that no task of the present stage has asked for is let go, and its memory given back.
    """
    context = TaskContext.get()
    stage = context.stageId() if context else -1
    got = _KEPT.get(kind)
    if got is None or got[0] != key:
        gone = [k for k, x in _KEPT.items() if k == kind or x[2] != stage]
        for old in gone:
            del _KEPT[old]
        if gone:
            give_back()
        got = (key, make(), stage)
    _KEPT[kind] = (got[0], got[1], stage)
    return got[1]


def give_back() -> None:
    """Freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


class Remembered(dict):
    """word -> make(word), in two generations of at most `most` words: a full young one becomes the old one, words used again move up."""

    def __init__(self, make, most: int = 50_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


def byte_characters() -> dict[int, int]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 as itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


def _setup(content: bytes) -> dict:
    """What a BPE file says: pattern, lower, suffix, vocab, merges; {} if it is of a kind that ranks do not cover."""
    file = json.loads(content)
    model, pre, norm = file["model"], file["pre_tokenizer"] or {}, json.dumps(file["normalizer"])
    plain = [p for p in (pre.get("pretokenizers") or [pre])]
    split = next((p["pattern"]["Regex"] for p in plain if p.get("type") == "Split" and p.get("invert") and p.get("behavior") == "Removed"), None)
    level = next((p for p in plain if p.get("type") == "ByteLevel"), None)
    known = model.get("type") == "BPE" and level and not level.get("add_prefix_space") and (split or level.get("use_regex")) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    suffix = model.get("end_of_word_suffix") or ""
    if not known or bool(suffix) != bool(split) or file.get("truncation") or file.get("padding"):
        return {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return {"pattern": split or BYTE_LEVEL, "lower": "Lowercase" in norm, "suffix": suffix, "vocab": model["vocab"], "merges": merges}


def _ranks(setup: dict) -> tuple[dict[bytes, int], np.ndarray]:
    """Bytes -> rank, and the id of each rank. The end of a word is the byte zero, which is joined to the byte before it first of all."""
    suffix, vocab = setup["suffix"], setup["vocab"]
    ranks: dict[bytes, int] = {}
    ids: list[int] = []

    def put(key: bytes, name: str) -> None:
        if key in ranks:
            raise KeyError(name)
        ranks[key] = len(ids)
        ids.append(vocab.get(name, 0))

    chars = byte_characters()
    bare = {chr(c): b for b, c in chars.items()}

    def raw(name: str) -> bytes:
        end = suffix and name.endswith(suffix)
        return bytes(bare[c] for c in (name[: -len(suffix)] if end else name)) + (b"\x00" if end else b"")

    if suffix:
        for b, c in chars.items():
            if b:
                put(bytes([b, 0]), chr(c) + suffix)
    for b, c in chars.items():
        put(bytes([b]), chr(c))
    for a, z in setup["merges"]:
        put(raw(a)[:-1] + raw(z) if suffix and a.endswith(suffix) else raw(a) + raw(z), a + z)
    return ranks, np.array(ids, dtype="<u4")


def consistent(content: bytes) -> bool:
    """Whether every entry of the vocabulary is encoded as itself by the file's own merges."""
    from tokenizers.models import BPE

    try:
        setup = _setup(content)
        if not setup:
            return False
        _ranks(setup)
        if len(setup["vocab"]) != len(set(setup["vocab"].values())):
            return False
    except KeyError:
        return False
    suffix, mark = setup["suffix"], "\ue000"
    name = (lambda w: w[: -len(suffix)] + mark if w.endswith(suffix) else w) if suffix else (lambda w: w)
    first = [(w[: -len(suffix)], mark) for w in setup["vocab"] if suffix and w.endswith(suffix) and len(w) == len(suffix) + 1]
    vocab = {name(w): i for w, i in setup["vocab"].items()}
    if suffix:
        vocab[mark] = max(vocab.values()) + 1
    model = BPE(vocab=vocab, merges=[*first, *((name(a), name(z)) for a, z in setup["merges"])])
    return all([t.id for t in model.tokenize(w)] == [i] for w, i in vocab.items())


class Encoder:
    """text -> its ids, as the library gives them. Holds the tokenizer and its ranks, and nothing of the texts."""

    def __init__(self, content: bytes, by_ranks: bool):
        import regex
        import tiktoken

        self.tok = load(content)
        self.marks = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.core = self.slow = None
        if by_ranks:
            setup = _setup(content)
            self.lower, self.words = setup["lower"], bool(setup["suffix"])
            ranks, self.ids = _ranks(setup)
            self.same = np.array_equal(self.ids, np.arange(len(self.ids)))
            # ids come as bytes only from the call that knows special tokens: it is given one, and never lets it stand for itself
            self.made = lambda pattern: tiktoken._tiktoken.CoreBPE(ranks, {UNUSED: len(self.ids)}, pattern)
            self.runs = not self.words and setup["pattern"] == BYTE_LEVEL  # whether texts with runs of white space need a core of their own
            self.core = self.made(r"[^\s\x00]+\x00" if self.words else NO_RUNS if self.runs else setup["pattern"])
            self.find = regex.compile(setup["pattern"]).findall

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def ended(self, word: str) -> str:
        """The pieces of a word that is not letters alone, with the end of a word between them."""
        if not word[-1].isalnum() and word[:-1].isalpha():
            return f"{word[:-1]}\x00 {word[-1]}"
        return "\x00 ".join(self.find(word))

    def plain(self, text: str) -> np.ndarray:
        """The ids of a text without odd characters."""
        if self.words:
            text = text.lower() if self.lower else text
            text = "\x00 ".join([w if w.isalpha() else self.ended(w) for w in text.split()]) + "\x00"
        core = self.core
        if self.runs and RUN.search(text):
            core = self.slow = self.slow or self.made(BYTE_LEVEL)
        ranks = np.frombuffer(core.encode_to_tiktoken_buffer(text, set()), dtype="<u4")
        return ranks if self.same else self.ids.take(ranks)

    def __call__(self, text: str) -> np.ndarray:
        if self.core is None or any(m in text for m in self.marks):
            return self.library(text)
        if not ODD.search(text):
            return self.plain(text)
        parts = re.findall(f"[^{WHITE}]+", text) if self.words else LINE_END.split(text)
        return np.concatenate([self.library(p) if ODD.search(p) else self.plain(p) for p in parts]) if parts else np.zeros(0, dtype="<u4")


class Decoder:
    """ids -> text, as the library gives it, special tokens kept."""

    def __init__(self, content: bytes):
        self.tok = load(content)
        bare = json.loads(content)["decoder"] is None  # then tokens are joined by spaces
        self.names = np.array([self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())], dtype=object) if bare else None

    def __call__(self, ids: np.ndarray) -> str:
        if self.names is None:
            return self.tok.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(self.names.take(ids).tolist())


def encoder(shipped: tuple[bytes, bool]) -> Encoder:
    """The encoder of what ship() sent, once for each worker."""
    return once("encoder", hash(shipped[0]), lambda: Encoder(*shipped))
