import hashlib
import json
import random
import zlib

import numpy as np
import pytest

from corvane.llm import bpe_chunks, range_coder, token_counts, token_files, vocab


def library(name, texts):
    tok = vocab.load(open(vocab.default_path(name), "rb").read())
    return tok, [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def raw(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_chunks_equal_library(spark, docs, odd):
    tok, ids = library("word_bpe_49k.json", [t for _, t in odd])
    got = sorted(tuple(r) for r in bpe_chunks.encode_table(docs(odd)).collect())
    want = sorted((i, len(x), hashlib.sha256(raw(x)).hexdigest(), hashlib.sha256(tok.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (i, _), x in zip(odd, ids))
    assert got == want


def encoder(name):
    content = open(vocab.default_path(name), "rb").read()
    return vocab.Encoder(content, vocab.consistent(content))


def scraps(n=1500):
    """Short texts of everything the splitting rules, cases, forms and white space turn on."""
    rnd = random.Random(5)
    signs = "abcdeéßAZ  \n\t'sS'lldm|#€漢½²\xa0 İ\x1c\r<>_12ǅ\u0301\xad\x00\u2003"
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 70))) for _ in range(n)] + ["a<|endoftext|>b <|startoftext|> c", "", " "]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ranks_equal_library(name):
    content = open(vocab.default_path(name), "rb").read()
    assert vocab.consistent(content)  # every entry of the vocabulary is encoded as itself
    texts = scraps()
    for by_ranks in (True, False):
        e = vocab.Encoder(content, by_ranks)
        assert [e(t).tolist() for t in texts] == [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]


def test_files_that_ranks_do_not_cover_go_to_the_library():
    content = json.loads(open(vocab.default_path("byte_bpe_50k.json"), "rb").read())
    content["model"]["merges"] = [m for m in content["model"]["merges"] if m != ["h", "e"]]  # entries made from it are out of reach
    assert not vocab.consistent(json.dumps(content).encode())
    assert not vocab.consistent(json.dumps(content | {"truncation": {"max_length": 5}}).encode())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_are_reused_and_joins_repaired(name):
    e = encoder(name)
    rng = np.random.default_rng(1)
    passage = "".join(rng.choice(list("abcdefghij klm,.é"), 6000))
    texts = ["x" + passage, "yy " + passage, passage[::-1], passage.replace(" ", ""), "漢字" * 3000, *scraps(200), *("".join(scraps(60)[k::5]) for k in range(5))]
    c = bpe_chunks.Chunks(e)
    got = [np.frombuffer(x, "<u4").tolist() for x in c.encode_texts(texts)]
    assert got == [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    assert c.reused > 5 and c.joined > 20


def test_disagreement_lets_the_window_grow():
    """A chunk whose kept ids are wrong at its end never gets into the result."""
    e = encoder("word_bpe_49k.json")
    c = bpe_chunks.Chunks(e)
    pieces = ["one two three four five si", "x seven eight nine ten eleven tw", "elve thirteen fourteen fifteen sixteen"]
    bad = c.fresh(pieces[1])
    c.young[pieces[1]] = bad._replace(first=b"\x01\x00\x00\x00")
    assert np.array_equal(np.frombuffer(c.encode(pieces), "<u4"), e("".join(pieces))) and c.grown == 1


def test_reuse_on_real_documents(spark):
    """What the memory of chunks, and both tiers of the counts, are asked for and know, in one worker over sf0.01."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    c = bpe_chunks.Chunks(encoder("word_bpe_49k.json"))
    for k in range(0, len(texts), bpe_chunks.GROUP):
        list(c.encode_texts(texts[k : k + bpe_chunks.GROUP]))
    assert c.met > 5000 and c.reused / c.met > 0.05 and c.joined >= c.met - c.reused - len(texts)
    shipped = (open(vocab.default_path("byte_bpe_50k.json"), "rb").read(), True)
    n = token_counts.Counter(shipped, token_counts.frequent_lengths(vocab.load(shipped[0])))
    for t in texts:
        n(t)
    assert n.first / n.met > 0.2 and (n.first + n.second) / n.met > 0.6


def test_counts_equal_library(spark, docs, odd):
    _, ids = library("byte_bpe_50k.json", [t for _, t in odd])
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs(odd)).collect())
    assert got == sorted((i, len((t or "").encode()), len(x), len(x) > 1024) for (i, t), x in zip(odd, ids))


def test_files_round_trip(spark, docs, odd, tmp_path):
    _, ids = library("byte_bpe_50k.json", [t for _, t in odd])
    rows = sorted(((i, t or "", x + [0]) for (i, t), x in zip(odd, ids)), key=lambda r: (r[0], r[1]))
    start = np.cumsum([0] + [len(x) for *_, x in rows])
    got = sorted(tuple(r) for r in token_files.round_trip(docs(odd), str(tmp_path / "f")).collect())
    assert got == sorted((i, int(s), len(x), zlib.crc32(raw(x))) for (i, _, x), s in zip(rows, start))
    assert sorted(bytes(r.ids) for r in token_files.read(spark, str(tmp_path / "f")).collect()) == sorted(raw(x) for *_, x in rows)


def test_empty_tables(spark, docs, tmp_path):
    none = docs([])
    assert bpe_chunks.encode_table(none).count() == token_counts.count_tokens(none).count() == token_files.round_trip(none, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("ids", [[], [7], [0] * 3000, [2**32 - 1, 0] * 700, list(np.random.default_rng(2).integers(0, 2**32, 70000)), list(range(65536)) + [5], list(range(2048)), [50256] * 1025, list(np.random.default_rng(0).integers(0, 131072, 3000)), list(np.random.default_rng(0).zipf(1.3, 5000) % 50257)])
def test_range_coder(ids):
    ids = np.array(ids, dtype=np.int64)
    data = range_coder.encode(ids)
    assert np.array_equal(range_coder.decode(data), ids)


def test_range_coder_detects_damage_and_predicts():
    ids = np.tile(np.random.default_rng(0).integers(0, 50257, 31), 300)
    data = range_coder.encode(ids)
    assert len(data) < len(ids) / 2
    bad = bytearray(data)
    bad[40] ^= 1
    with pytest.raises(range_coder.Damaged):
        range_coder.decode(bytes(bad))


def test_range_coder_refuses_what_is_no_id():
    for bad in ([-1], [1 << 32]):
        with pytest.raises(ValueError):
            range_coder.encode(np.array(bad))


def test_every_damage_is_told():
    data = range_coder.encode(np.random.default_rng(3).integers(0, 500, 4000))
    for at in range(0, len(data), 37):
        bad = bytearray(data)
        bad[at] ^= 4
        try:
            range_coder.decode(bytes(bad))
        except range_coder.Damaged:
            continue
        assert bytes(bad) == data, at
    with pytest.raises(range_coder.Damaged):
        range_coder.decode(data[:-3])


def test_blocks_are_smaller_than_deflated_ones(spark):
    """On real ids the models pay: each block is held against zlib on the same ids, at two bytes each."""
    e = encoder("byte_bpe_50k.json")
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ids = np.concatenate([e(t) for t in texts])
    whole = ids[: len(ids) // range_coder.BLOCK * range_coder.BLOCK]
    plain = sum(len(zlib.compress(whole[k : k + range_coder.BLOCK].astype("<u2").tobytes())) for k in range(0, len(whole), range_coder.BLOCK))
    assert len(whole) and len(range_coder.encode(whole)) < plain


def test_null_and_repeated_ids_in_files(spark, docs, tmp_path):
    rows = [(None, "b c"), (None, "a"), (3, "x"), (3, "x"), (-2, None)]
    e = encoder("byte_bpe_50k.json")
    token_files.write(docs(rows), str(tmp_path / "n"))
    got = sorted(token_files.read(spark, str(tmp_path / "n")).collect(), key=lambda r: r.start)
    order = [(None, "a"), (None, "b c"), (-2, ""), (3, "x"), (3, "x")]
    assert [(r.doc_id, bytes(r.ids)) for r in got] == [(i, raw([*e(t), 0])) for i, t in order]
    assert [r.start for r in got] == np.cumsum([0] + [len(e(t)) + 1 for _, t in order])[:-1].tolist()


def test_columns_named_like_the_results(spark):
    rows = spark.createDataFrame([(1, "a cat", b"old", "old")], "doc_id bigint, text string, ids binary, decoded string")
    r = bpe_chunks.with_ids(rows, decode=True).first()
    e = encoder("word_bpe_49k.json")
    assert bytes(r.ids) == raw(e("a cat")) and r.decoded == e.tok.decode(e("a cat").tolist(), skip_special_tokens=False)


def test_ids_come_as_bytes_and_no_text_is_special():
    """Ids are read from the encoder's own bytes, not from a list; the special token that this call needs never stands for itself."""
    with open(vocab.default_path("byte_bpe_50k.json"), "rb") as f:
        e = vocab.Encoder(f.read(), True)
    assert not e.plain("some words").flags.writeable
    for text in ("", "some words\n", f"a {vocab.UNUSED} b", vocab.UNUSED * 3):
        assert e.plain(text).tolist() == e.library(text).tolist()
